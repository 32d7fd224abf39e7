"""Reading collections and placing intermediate tables."""
