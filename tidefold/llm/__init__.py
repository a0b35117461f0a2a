"""Training-data operators: tokenising, filtering, deduplication, formatting and sharding of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` registers the thin ``opN_*`` queries that derive contract columns from the operators.
"""
