"""Quarry: catalog retrieval, its evaluation and corpus preparation as Spark plans."""
