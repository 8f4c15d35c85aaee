"""Document-corpus and citation-graph analytics on Spark DataFrames."""
