"""Operators for preparing language-model training data, and their queries.

Nothing else in the package imports this folder. Every operator takes and
returns DataFrames; inside tasks they work on Arrow batches with numpy.
"""
