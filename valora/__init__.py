"""Spark-native comparable-sales valuation engine."""
