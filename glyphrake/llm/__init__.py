"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` in ``catalog`` lists the
registered queries, one module per operator holds the code.
"""
