"""Operators for preparing large text corpora, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries, one module per operator holds the operator itself.
"""
