"""Lazy DataFrame operators (each returns a DataFrame; none collects)."""
