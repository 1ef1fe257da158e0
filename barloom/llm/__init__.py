"""Operators for building training corpora out of very large document tables.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds its queries when
it is there.
"""
