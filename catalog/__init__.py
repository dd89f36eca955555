"""The registered queries: each runs a library operator on the given tables, most with a SQL twin."""
