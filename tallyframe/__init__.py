"""Evidence-screening and evaluation analytics on Spark DataFrames."""
