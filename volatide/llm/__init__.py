"""Operators for preparing training corpora. Nothing else in volatide imports this package."""
