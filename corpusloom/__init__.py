"""Evidence retrieval, evaluation and document analytics on Spark DataFrames."""
