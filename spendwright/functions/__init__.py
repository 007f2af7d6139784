"""Column-level building blocks: hashing, grids, distribution tails."""
