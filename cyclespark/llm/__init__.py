"""Training-data operators: deduplication, tokenisation, packing, search, quality and PII.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
