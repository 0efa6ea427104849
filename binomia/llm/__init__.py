"""Operators for preparing training text at scale.

Nothing else in :mod:`binomia` imports this subpackage.
"""
