"""Training-data operators: language ID, extraction, packing, token files, deduplication, fingerprints, sampling and LM scoring.

Nothing outside this subpackage imports it.
"""
