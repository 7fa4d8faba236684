"""Corpus operators for training-data preparation.

Nothing outside this package imports it.  Each operator lives in a module of its
own; ``corvane.llm.queries`` holds the registered queries and their SQL.
"""
