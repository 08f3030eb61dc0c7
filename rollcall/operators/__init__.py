"""Operators over whole tables: ingest, parsing, matching, ledger, identity, editions, graph."""
