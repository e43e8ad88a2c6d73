"""Operators of the market-price engine."""
