"""Analytics over evaluation criteria and text records, expressed as Spark jobs."""
