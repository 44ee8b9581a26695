"""Packet-context analytics on Spark DataFrames."""
