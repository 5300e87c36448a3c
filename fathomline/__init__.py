"""Liquidity risk analytics and training-data operators on Spark DataFrames."""
