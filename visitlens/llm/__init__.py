"""Operators for building language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage; ``__spark_entry__`` registers its queries
when it is there.
"""
