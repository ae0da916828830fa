"""Event-stream processing, delivery and health monitoring as Spark jobs."""
