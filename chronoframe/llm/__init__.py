"""Training-data operators: ten methods over documents, pages, conversations and vectors.

Nothing outside this subpackage imports it.
"""
