"""Spark-native operators for layered knowledge graphs and the corpora behind them."""
