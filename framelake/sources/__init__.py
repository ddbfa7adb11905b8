"""framelake sources."""
