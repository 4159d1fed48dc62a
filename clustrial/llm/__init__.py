"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Operators take a frame and the names of
the columns they work on, pick those columns at once, and ignore every other column.
"""
