"""framelake plans."""
