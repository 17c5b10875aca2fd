"""A temporal fact engine with Datalog queries on Spark DataFrames."""
