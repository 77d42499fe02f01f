"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each operator is a module with its own
general interface; ``queries`` holds the thin registered queries and ``oracles``
their SQL.
"""
