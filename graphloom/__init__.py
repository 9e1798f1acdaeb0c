"""Knowledge-graph building and retrieval over document collections, as Spark DataFrames."""
