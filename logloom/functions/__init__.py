"""Column-expression builders: parsing, normalisation, predicates and aggregates.

Everything here returns a ``pyspark.sql.Column`` made of built-in functions, so it stays
inside whole-stage code generation and is visible to the optimizer.
"""
