"""All registered queries of the library: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from listingloom.plans import queries_contract, queries_cycle, queries_events, queries_extract, queries_resolve, queries_runs, queries_store

ALL = {**queries_runs.QUERIES, **queries_events.QUERIES, **queries_store.QUERIES, **queries_extract.QUERIES, **queries_cycle.QUERIES, **queries_resolve.QUERIES, **queries_contract.QUERIES}
