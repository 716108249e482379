"""Finds, classifies, protects and restores sensitive data in columns of text at cluster scale."""

__version__ = "0.1.0"
