"""Search and maintenance of hierarchical name catalogues on Spark DataFrames."""
