"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``registry`` turns them into queries.
"""
