"""Queries over the given tables: each operator bound to columns, with an equivalent SQL text where SQL can say it."""
