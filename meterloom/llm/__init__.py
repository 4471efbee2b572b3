"""Operators of a training-data pipeline: one module an operator, ``registry`` for the queries."""
