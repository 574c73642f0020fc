"""Operators for building training data: packing, deduplication, archives, language, mixing, extraction, privacy, search.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries only when it is there.
"""
