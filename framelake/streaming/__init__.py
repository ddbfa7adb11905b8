"""framelake streaming."""
