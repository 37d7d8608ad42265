"""Training-data operators: packing, fingerprints, de-duplication, scoring, scans and shards."""
