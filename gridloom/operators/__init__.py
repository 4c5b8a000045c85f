"""Relational operators on lattices: DataFrame in, DataFrame out."""
