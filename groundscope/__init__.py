"""Value grounding and query-evaluation analytics as Spark DataFrame operators."""
