"""Operators for preparing large text corpora; nothing else in orfweave imports this subpackage."""
