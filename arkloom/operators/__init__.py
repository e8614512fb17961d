"""Named operators with validated parameters."""
