"""Operators for cleaning large text corpora: quality scoring, near-duplicate
detection, packing, page extraction, licence, privacy and secret scans,
decontamination and substring deduplication. Nothing outside this package
imports it."""
