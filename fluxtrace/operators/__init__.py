"""Operators on recordings.

A recording is a long table keyed by ``rec`` and ``idx`` (the sample's number from 0).
Windows are always partitioned by ``rec``, so a chain of operators shares one shuffle.
Missing values are NULL, never NaN.
"""
