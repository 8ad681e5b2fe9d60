"""Training-data operators: near-duplicates, tokens, sharding, filters, language models, packing.

Nothing else in the library imports this subpackage; its queries are listed in
``mirepoix.llm.queries``.
"""
