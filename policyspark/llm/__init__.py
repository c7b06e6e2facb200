"""Operators for preparing training data, built as Spark jobs.

Each module holds one operator with its own general interface and the thin
``opN_`` query that applies it to the benchmark tables.
"""
