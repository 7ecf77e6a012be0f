"""Ravelin: question-routing and retrieval analytics on Spark DataFrames."""
