"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every module holds one operator with a general
interface; ``queries.py`` holds the thin ``opN_<name>`` queries that bind them to the tables.
"""
