"""Training-data operators: language ID, mixing, de-duplication, secret and PII scans, token output and packing."""
