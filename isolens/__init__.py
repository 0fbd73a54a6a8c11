"""isolens: tenant-isolation analytics on Spark DataFrames."""
