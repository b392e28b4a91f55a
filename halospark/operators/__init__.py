"""Relational building blocks: filters, joins, aggregates, windows and grids over DataFrames."""
