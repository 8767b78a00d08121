"""Operators for building training corpora, as Spark jobs.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
