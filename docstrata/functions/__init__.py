"""Functions on texts and columns."""
