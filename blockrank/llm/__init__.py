"""Operators for preparing training text. Nothing else in blockrank imports this package."""
