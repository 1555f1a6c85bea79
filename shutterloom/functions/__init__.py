"""Scalar functions, as Columns wherever the built-ins can express them."""
