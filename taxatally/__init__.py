"""Read-count analytics for taxon-by-sample data on Spark DataFrames."""
