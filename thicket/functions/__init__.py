"""Column functions and numpy kernels."""
