"""draftlens: drawing-quality analytics and corpus preparation on Spark DataFrames."""
