"""Training-data operators: token files, language, duplicates, mixing, media, packing, filters."""
