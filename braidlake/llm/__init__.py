"""Training-data operators: tokens, mixing, packing, quality, near-duplicates, licenses, chats, languages."""
