"""Operators of a training-data pipeline (search, joins, language ID, token
counts, archives, near duplicates, packing, tool calls, toxicity, mixing).

Nothing outside this package imports it; ``queries`` registers its queries.
"""
