"""Training-data operators: near-duplicates, filters, classifiers, tokenizers and extraction.

Nothing else in the library imports this subpackage.
"""
