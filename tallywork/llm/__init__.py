"""Operators of a training-data pipeline over documents, pages and vectors. Nothing outside this folder imports it."""
