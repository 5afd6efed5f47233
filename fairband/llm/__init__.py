"""Operators for building text corpora; each module holds one, ``queries`` registers them."""
