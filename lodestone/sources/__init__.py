"""Source texts and report files as DataFrames."""
