"""Training-data operators: dedup, decontamination, language ID, mixing, PII, chat, licences, WARC."""
