"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; `queries.py` registers its
queries and `sql.py` holds their oracle SQL.
"""
