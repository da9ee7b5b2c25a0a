"""plinth: typed, closed analytics plans compiled to Spark DataFrames."""
