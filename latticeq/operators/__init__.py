"""Operators as DataFrame plans: criteria, arithmetic, comparisons, vectors, merges, pivots, orders."""
