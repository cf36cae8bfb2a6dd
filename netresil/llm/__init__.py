"""Operators on text collections for training-data preparation.

The road-network records hold no running text, so these operators are general:
they take any table with an id and a text column. Nothing else in the library
imports this package.
"""
