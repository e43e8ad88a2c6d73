"""Sources of the market-price engine."""
