"""Training-corpus operators on Spark: mixing, quality, de-duplication, packing, extraction, search, sharding."""
