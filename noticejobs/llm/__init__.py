"""Training-data operators: language, tokens, quality, privacy, search, duplicates, licences.

Nothing else in the package imports this folder; its queries are in ``noticejobs.llm.queries``.
"""
