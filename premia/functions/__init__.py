"""Column functions with the rounding, hashing and quantile rules that hold across the library."""
