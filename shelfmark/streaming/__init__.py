"""Reports over collections that keep arriving."""
