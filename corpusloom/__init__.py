"""Corpus analytics on Spark: text cleaning, language filtering, deduplication, splitting, error synthesis and scoring."""
