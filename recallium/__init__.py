"""Long-term memory retrieval, lifecycle and text-corpus analytics on Spark DataFrames."""
