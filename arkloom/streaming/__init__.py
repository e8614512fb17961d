"""Word counts over growing folders; an extension with no counterpart in batch."""
