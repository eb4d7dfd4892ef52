"""Training-data operators: tokens, quality filters, near-duplicates, mixing and nearest neighbours.

Nothing else in the library imports this subpackage.
"""
