"""Column functions: vectors, geodesy, header text."""
