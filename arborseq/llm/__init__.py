"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each operator has a module with a
general interface; ``queries`` holds the thin driver queries built on them.
"""
