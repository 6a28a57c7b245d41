"""Training-data operators over documents, pages, embeddings and benchmarks.

Nothing else in the library imports this subpackage.
"""
