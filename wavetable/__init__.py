"""Recording analytics on Spark: DataFrame operators over chunk, fold and prediction tables."""
