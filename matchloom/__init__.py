"""Record linkage and text analytics on PySpark."""
