"""Scalar functions, as columns wherever Spark can express them."""
