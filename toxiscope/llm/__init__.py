"""Operators for large training-data pipelines.

Nothing outside this folder imports it: ``__spark_entry__`` adds the queries
of :mod:`toxiscope.llm.queries` only when the folder is there.
"""
