"""docloom: search, classify, organise and check large document collections with Spark DataFrames."""
