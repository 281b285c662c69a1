"""Operators of a training-data pipeline: cleaning, de-duplication, mixing and tokenisation of document tables.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and their SQL.
"""
