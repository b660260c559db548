"""Column functions: no shuffles, no Python on the executors."""
