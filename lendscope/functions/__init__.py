"""Column-expression helpers: label ladders, p-value math, small utilities."""
