"""A provenance-first knowledge-graph engine on Spark DataFrames."""
