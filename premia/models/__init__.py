"""Regressors in NumPy that are small enough for one task; the cluster fits many of them at once and scores with them."""
