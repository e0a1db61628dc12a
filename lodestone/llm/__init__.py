"""Operators for large training corpora: duplicates, licences, language, shards, packing, tokens, personal data and vectors."""
