"""Streaming: intentionally empty.

The reference has no streaming input, watermark, windowed or stateful
operator; all its inputs are finished tables.  The mergeable aggregates used
here (sum, count, avg, conditional sums) would run unchanged on a
Structured Streaming DataFrame, but no streaming operator is part of the
reference's capabilities, so none is built.
"""
