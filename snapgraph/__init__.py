"""snapgraph: graph-streaming and ordered-collection analytics on Spark DataFrames."""
