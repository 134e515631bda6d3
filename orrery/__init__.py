"""orrery: a search, aggregation and record-processing engine on PySpark."""
