"""Reading tables, annotating rows, and the typed CSV format."""
