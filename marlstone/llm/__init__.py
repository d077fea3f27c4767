"""Training-data operators: sharding, fingerprints, mixing, scoring, language ID, token output."""
