"""Training-data operators: extraction, scoring, near-duplicates, packing, encoding, sharding.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries if it can be imported.
"""
