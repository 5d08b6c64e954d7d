"""The same buckets over unbounded input."""

from sluice.streaming.windows import stream_stats, tumbling

__all__ = ["stream_stats", "tumbling"]
