"""Layered lake analytics and lineage as Spark DataFrame jobs."""
