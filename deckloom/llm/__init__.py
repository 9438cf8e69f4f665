"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`deckloom.llm.queries` registers the
production queries built from them.
"""
