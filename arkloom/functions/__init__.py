"""Column functions: text, HTML, rows, statistics."""
