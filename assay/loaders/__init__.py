"""Model files and tree dumps."""
