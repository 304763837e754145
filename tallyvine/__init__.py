"""Yearly harvest analytics on PySpark DataFrames."""
