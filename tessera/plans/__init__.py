"""Tessera: plans."""
