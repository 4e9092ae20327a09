"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.  Functions that run on executors are
pickled by value, so workers need no package path.
"""
