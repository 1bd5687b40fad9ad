"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and the SQL that ``__spark_entry__.py`` adds when the subpackage is present.
"""
