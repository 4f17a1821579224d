"""Exact pattern counting and order-1 statistics over symbol sequences, on Spark DataFrames."""
