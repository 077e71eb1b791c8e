"""Vecloom: vector search, hybrid retrieval and retrieval analytics as Spark DataFrame plans."""
