"""Hedonic price analytics on Spark."""
