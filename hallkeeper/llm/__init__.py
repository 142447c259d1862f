"""Training-data operators: licences, PII, extraction, near duplicates, quality, tokens, contamination."""
