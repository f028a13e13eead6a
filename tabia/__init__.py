"""Customer financial-behaviour analytics as Spark DataFrame jobs."""
