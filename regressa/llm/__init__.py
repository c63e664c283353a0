"""Training-data operators: formatting, deduplication, mixing, packing, scans, sharding, token
counts and a quality classifier. Nothing outside this folder imports it."""
