"""Operators on DataFrames: stages, search, sequences, graphs, folds, joins, aggregates."""
