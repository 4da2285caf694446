"""Training-data operators: deduplication, filtering, packing and tokenised output.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with a general interface, its thin registered query and, where SQL can
express it, the query's SQL.
"""
