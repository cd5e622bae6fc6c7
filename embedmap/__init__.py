"""embedmap: explore embedding datasets with Spark DataFrames."""
