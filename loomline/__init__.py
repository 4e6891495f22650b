"""loomline: retrieval, text and training-data operators expressed as Spark plans."""
