"""Operators of a training-data pipeline: packing, sharding, joins, search, tokens and screens."""
