"""Training-data operators: near-duplicates, archives, packing, extraction, filters, chat and leak checks."""
