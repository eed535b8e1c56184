"""Multidimensional queries compiled to Spark DataFrame plans."""
