"""Relational operators Spark has no single call for.

All of them keep one key's rows spread over many tasks, so a key holding a
large share of the table neither fills one task nor the driver.
"""
