"""Operators of a training-data pipeline.

One module per operator (``op01_...`` to ``op10_...``); ``queries`` registers
one query per operator and ``oracle`` holds the DuckDB SQL of those that SQL
can express.  Nothing outside this package imports it.
"""
