"""Operators for preparing text corpora: packing, scoring, archives, fingerprints, deduplication,
licences, toxicity, vector search, mixing and chat formatting. Nothing outside imports this package."""
