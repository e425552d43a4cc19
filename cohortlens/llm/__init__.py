"""Operators of a training-data pipeline: near-duplicates, sharding, search, line dedup,
mixing, packing, URL filters, token files and language ID. Nothing else in the library
imports this subpackage; its queries are in ``cohortlens.llm.queries``.
"""
