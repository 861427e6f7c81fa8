"""Evidence retrieval and answer analytics on Spark DataFrames."""
