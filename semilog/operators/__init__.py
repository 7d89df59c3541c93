"""Operators over DataFrames that programs or callers use directly."""
