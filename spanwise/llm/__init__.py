"""Training-data operators: dedup, quality, packing, search, chat, toxicity, HTML and mixing.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
