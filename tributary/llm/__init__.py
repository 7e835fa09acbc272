"""Training-data operators: tokenising, extraction, filtering, deduplication, packing, formatting.

Nothing outside this folder imports it; ``tributary.llm.registry`` lists its queries.
"""
