"""Operators for preparing training text: one module per operator, and the queries that run them."""
