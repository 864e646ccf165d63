"""DataFrame operators over ordered observations; they take column names and return DataFrames."""
