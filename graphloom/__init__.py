"""Property graphs as two DataFrames, and the operators that work on them."""
