"""runlens: workflow-history analytics on Spark DataFrames."""
