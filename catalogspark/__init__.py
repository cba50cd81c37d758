"""Federated-catalog analytics on Spark DataFrames."""
