"""Registered queries: the reference operators over the driver's tables."""
