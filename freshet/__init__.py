"""freshet: hydrological data jobs on Spark DataFrames."""
