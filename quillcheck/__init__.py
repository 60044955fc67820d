"""Evidence-checking analytics on PySpark."""
