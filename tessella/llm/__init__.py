"""Operators of a training-data pipeline: mixing, dedup, tokens, archives, rules, fingerprints, shards, licences, phrases, whitening."""
