"""Operators for preparing training text: ten DataFrame-in, DataFrame-out modules."""
