"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
