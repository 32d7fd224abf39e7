"""Column expressions the reports share."""
