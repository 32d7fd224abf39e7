"""Several reports built over one prepared table."""
