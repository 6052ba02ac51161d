"""Training-data operators: tokens, packing, near-duplicates, quality, secrets, licences, media."""
