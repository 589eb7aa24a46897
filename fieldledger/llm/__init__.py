"""Operators for preparing training data: one module per operator, their queries in ``queries``."""
