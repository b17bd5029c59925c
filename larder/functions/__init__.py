"""Column functions and the plain functions behind them."""
