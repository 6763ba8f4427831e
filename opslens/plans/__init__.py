"""Reports: each takes captured tables and parameters and returns a lazy DataFrame.

``server_name`` is part of every key. Ages are relative to an explicit
``as_of``; no report reads the clock.
"""
