"""Facts from files, models and DataFrames, and results as text."""
