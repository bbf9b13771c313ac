"""graphloom: typed object and link graphs, their queries and analytics, on Spark DataFrames."""
