"""Operators for preparing large text corpora, each a plan over DataFrames.

Nothing outside this subpackage imports it.
"""
