"""Pure functions of logical statistics."""
