"""Operators for preparing language-model training text; nothing else in halyard imports this."""
