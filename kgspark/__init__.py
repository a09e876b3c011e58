"""kgspark: knowledge-graph lookup, enrichment and corpus preparation on PySpark."""
