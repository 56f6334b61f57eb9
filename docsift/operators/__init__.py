"""Relational, retrieval and answer operators over DataFrames."""
