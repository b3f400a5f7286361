"""Turnloom: transcript analytics on Spark DataFrames."""
