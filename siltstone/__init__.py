"""Siltstone: data quality, BI analytics and table cleaning as Spark jobs."""
