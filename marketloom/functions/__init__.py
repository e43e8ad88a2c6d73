"""Functions of the market-price engine."""
