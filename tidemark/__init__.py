"""Progressive approximate analytics on PySpark."""
