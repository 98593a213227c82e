"""Retrieval, graph analytics and text pipelines as DataFrame plans."""
