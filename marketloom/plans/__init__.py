"""Plans of the market-price engine."""
