"""Evidence-backed record discovery and corpus preparation on PySpark."""
