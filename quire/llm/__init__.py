"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries that ``__spark_entry__.py`` adds when the subpackage is present.
"""
