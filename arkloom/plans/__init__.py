"""Plans made of several steps: n-grams, indexes, similarity, transcripts."""
