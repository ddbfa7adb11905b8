"""framelake operators."""
