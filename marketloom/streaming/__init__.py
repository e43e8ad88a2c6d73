"""Streaming of the market-price engine."""
