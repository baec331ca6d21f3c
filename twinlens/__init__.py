"""twinlens: pairwise near-duplicate analytics on Spark DataFrames."""
