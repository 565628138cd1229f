"""Training-data operators: chat formatting, sharding, secret scans, token counts,
decontamination, near-duplicates, packing, language id, quality rules and toxicity.

Nothing outside this subpackage imports it.
"""
