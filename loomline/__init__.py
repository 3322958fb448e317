"""Process mining and engineering-spend analytics as Spark jobs."""
