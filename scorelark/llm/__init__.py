"""Training-data operators: sharding, search, tokens, archives, licences, duplicates, leaks, quality, privacy, secrets.

Nothing outside this subpackage imports it.
"""
