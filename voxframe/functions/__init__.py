"""Column functions: no shuffles, no Python in the hot path."""
