"""Column -> Column builders.  Nothing here runs Python per row."""
