"""Joins, entity resolution, aggregations, windows, ordering, set operations and store updates."""
