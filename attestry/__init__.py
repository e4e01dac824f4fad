"""Evidence-backed relationship graphs as Spark jobs."""
