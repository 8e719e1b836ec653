"""Training-data operators: one module per operator, ``queries.py`` registers one query for each.

Nothing outside this subpackage imports it. Every operator takes DataFrames and plain parameters,
and reads and writes only through Spark, so inputs may lie in any store that Spark can open.
"""
