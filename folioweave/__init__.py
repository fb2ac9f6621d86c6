"""folioweave: page, text and memory analytics as lazy PySpark plans."""
