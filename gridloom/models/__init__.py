"""Spatial models: blocks of cells go to tasks, NumPy works inside a block, sums and joins stay in Spark.

Every model takes the lattice (cell_id, ix, iy, val; null: to be predicted) and returns (cell_id, mean, sd).
"""
