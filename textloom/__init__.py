"""textloom: parallel-text corpus analytics as Spark DataFrame transformations."""
