"""Column expressions: hashes and subsample ids."""
