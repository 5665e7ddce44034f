"""Training-data operators: ten independent Spark jobs over documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
