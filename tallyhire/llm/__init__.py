"""Training-data operators: scoring, tokenizing, filtering, packing, search, sharding and near-duplicate joins.

Nothing outside this subpackage imports it; its queries are in ``tallyhire.llm.queries``.
"""
