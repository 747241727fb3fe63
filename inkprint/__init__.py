"""Authorship analytics on DataFrames: text audit, normalisation, masking, stylometry, pairing and scoring."""
