"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Every module holds one
operator with a general interface and the thin ``opN_<name>`` query that
applies it to a whole table.
"""
