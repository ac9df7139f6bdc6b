"""Training-data operators: packing, licences, language, dedup, sharding, media, quality, URLs, BPE."""
