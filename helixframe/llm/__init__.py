"""Training-data operators: language ID, deduplication, decontamination, PII, chat, packing, WARC."""
