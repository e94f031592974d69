"""Training-data operators (language ID, PII, BPE, dedup, toxicity, WARC, decontamination)."""
