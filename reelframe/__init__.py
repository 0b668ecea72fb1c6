"""Film-shot and photo catalogue analytics as Spark jobs."""
