"""urlintel: bulk URL threat intelligence on Spark DataFrames."""
