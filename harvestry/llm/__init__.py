"""Operators of a training-data pipeline over crawled text; nothing outside this package imports it."""
