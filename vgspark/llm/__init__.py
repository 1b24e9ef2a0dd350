"""Training-data pipeline operators: one module an operator, queries and SQL beside them.

Nothing outside this subpackage imports it.
"""
