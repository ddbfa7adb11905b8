"""framelake functions."""
