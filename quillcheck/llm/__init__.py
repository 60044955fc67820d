"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``entry.queries()`` and
``entry.oracle_sql()`` hold what ``__spark_entry__`` registers.
"""
