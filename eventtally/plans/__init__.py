"""Whole jobs: ingest a batch, refresh the rollup, and the registered queries."""
