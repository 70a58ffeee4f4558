"""Operators for preparing training corpora: tokenising, fingerprints, dedup, language and quality models, mixing, search.

Nothing outside this subpackage imports it.
"""
