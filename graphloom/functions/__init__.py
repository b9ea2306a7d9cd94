"""Column functions: vector arithmetic, distances, portable pseudo-random numbers."""
