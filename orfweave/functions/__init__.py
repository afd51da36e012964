"""Part of orfweave."""
