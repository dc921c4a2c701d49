"""Training-data operators: extraction, deduplication, scoring, tokenising, mixing and packing.

Nothing outside this subpackage imports it; ``queries.py`` lists the registered queries.
"""
