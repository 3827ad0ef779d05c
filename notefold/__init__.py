"""Notefold: document and note analytics expressed as Spark DataFrame plans."""
