"""Training-data operators: sharding, packing, token files, near-duplicates, extraction,
quality rules, fixity audit, BPE, language ID and nearest neighbours.

Nothing outside this subpackage imports it.
"""
