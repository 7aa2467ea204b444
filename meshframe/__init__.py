"""meshframe: graphs of nodes and weighted, directed edges as Spark DataFrames."""
