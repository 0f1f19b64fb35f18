"""Training-data operators: tokens, deduplication, language, quality, decontamination, HTML, WARC and packing."""
