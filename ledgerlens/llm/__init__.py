"""Operators of a training-data pipeline: fingerprints, dedup, extraction, scoring, packing, filters and scans."""
