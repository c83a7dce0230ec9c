"""Training-data operators: mixing, deduplication, formatting, extraction, archives, scoring.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries.py`` registers the thin ``opN_<name>`` queries and
their DuckDB SQL.
"""
