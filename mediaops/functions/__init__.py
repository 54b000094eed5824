"""Column functions: time formats, box geometry, vector maths, text rules."""
