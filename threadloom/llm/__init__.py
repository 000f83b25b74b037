"""Training-data operators: chat formatting, quality rules, sketches, mixing,
HTML extraction, URL filters, language ID, packing, near-dedup and sharding.

Nothing outside this subpackage imports it; ``queries`` registers one query for
each operator.
"""
