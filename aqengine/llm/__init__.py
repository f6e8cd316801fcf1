"""Operators for building training corpora: ten DataFrame operators over documents and embeddings.

Nothing outside this folder imports it; ``queries`` registers one query for each operator.
"""
