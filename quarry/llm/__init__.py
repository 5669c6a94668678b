"""Training-data operators: filtering, scoring, deduplication, mixing, search.

Each module holds one operator with a general interface and the thin query
that applies it to its whole table.  ``queries.py`` lists them.  Nothing
outside this subpackage imports it.
"""
