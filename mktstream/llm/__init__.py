"""Training-data operators: near and exact dedup, tokenizing, scans, classifiers, decontamination, PII."""
