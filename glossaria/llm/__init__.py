"""Thirteen operators of a training-data pipeline, and the queries that apply them.

Nothing outside this subpackage imports it.
"""
