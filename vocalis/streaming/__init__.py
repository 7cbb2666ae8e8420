"""The same projections over streaming DataFrames."""
