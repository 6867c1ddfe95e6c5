"""Operators for preparing training data: tokens, duplicates, scores, filters, search.

Each module holds one operator with its own interface. ``queries`` applies them
to the given tables. Every operator reads ``doc_id`` and ``text`` (where not
stated otherwise) and ignores other columns, whatever their names are.
"""
