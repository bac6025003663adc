"""Operators of a training-data pipeline: tokenising, extraction, deduplication,
filtering, sharding and exact search. Nothing else in the package imports this
subpackage; ``queries.py`` holds the registered queries and their SQL."""
