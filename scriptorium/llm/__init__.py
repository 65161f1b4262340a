"""Operators for training-data pipelines over large text collections.

Each module holds one operator with a general interface, the thin query that
applies it to the shared test tables, and (where SQL can say it) the oracle.
Nothing outside this folder imports it.
"""
