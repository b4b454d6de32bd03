"""Operators for preparing text corpora: sharding, packing, tokenizing, de-duplication, scoring, extraction, filtering."""
