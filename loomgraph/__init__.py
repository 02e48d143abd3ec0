"""A Spark engine for questions over graphs that live in ordinary tables."""
