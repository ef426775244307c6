"""Training-data operators (line dedup, packing, toxicity, near-dedup, WARC, quality, ids, mixing).

Nothing outside this package, ``tests/llm`` and the guarded import in ``__spark_entry__.py`` uses it.
"""
