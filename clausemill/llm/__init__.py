"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; the registry of queries reaches it
only through a guarded import, so the folder can be removed as a whole.
"""
