"""Training-data operators: language ID, decontamination, WARC archives, fingerprints,
URL filters, packing, near-duplicates, line and substring dedup, HTML extraction.

Nothing else in the library imports this package; it imports nothing from the rest.
"""
