"""Training-data operators over the tables documents, pages, labels and benchmark.

Nothing outside this subpackage imports it.
"""
