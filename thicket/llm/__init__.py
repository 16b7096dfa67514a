"""Operations that a large training-data pipeline needs, on documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
