"""Operators of a training-data pipeline: search, packing, filters, token files, joins and scans of documents."""
