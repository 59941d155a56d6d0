"""A Spark-first engine for strict, typed, parallel CSV analytics.

sources: the strict record-splitting CSV reader, the common reader, sinks and generators
functions: strict typed conversions
operators: dictionary encoding, totals, comparison and integrity
plans: registered queries with their DuckDB oracles
streaming: incremental directory reads
"""
