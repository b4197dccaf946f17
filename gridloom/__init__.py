"""Volume analytics on Spark: scalar grids as DataFrames."""
