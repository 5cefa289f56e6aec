"""Spark-first record linkage: normalise, block, score, select, assign and evaluate noisy records."""
