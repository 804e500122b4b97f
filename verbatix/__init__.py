"""Passage retrieval, citation analytics and corpus preparation as Spark DataFrame plans."""
