"""Files as DataFrames, and what is read from each format."""
