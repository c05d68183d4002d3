"""Operators that prepare a large text corpus for training: near copies, labels, mixing, tokens, licences.

Nothing else in the library imports this subpackage.
"""
