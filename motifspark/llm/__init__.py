"""Corpus operators for language-model training data.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` registers the thin ``opN_<name>`` queries over the given tables.
"""
