"""Corpus-scale operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries.py`` derives
the fixed result columns from them.  Nothing outside this package imports it.
"""
