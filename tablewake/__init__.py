"""Table lineage and deletion audit as PySpark DataFrame jobs."""
