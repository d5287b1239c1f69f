"""Mountain search-and-rescue analytics as Spark jobs."""
