"""eventtally: event ingestion, deduplication and metrics as Spark jobs.

The sub-packages follow the path of an event:

* ``sources``    records, JSON payloads, the ledger, quarantine and rollup tables
* ``functions``  column expressions (keys, clock arithmetic, text rules)
* ``operators``  DataFrame transformations (validate, dedup, rollup, metrics)
* ``plans``      whole batch jobs and the registered queries
* ``streaming``  Structured Streaming jobs built on the same operators
"""
