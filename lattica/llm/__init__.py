"""Operators for building training corpora: one module per operator.

Nothing outside this subpackage imports it, so it can be removed as a unit.
``catalog`` lists its queries and their SQL.
"""
