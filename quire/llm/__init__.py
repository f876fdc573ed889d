"""Operators for preparing training data; nothing else in quire imports this."""
