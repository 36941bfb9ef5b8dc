"""Quire: cataloguing, querying and transforming serialized text on Spark."""
