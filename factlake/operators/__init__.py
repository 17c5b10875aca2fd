"""Transactions, points in time, pull and signed multisets."""
