"""Training-data operators: cleaning, scoring, matching and mixing of document corpora.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what the entry module registers.
"""
