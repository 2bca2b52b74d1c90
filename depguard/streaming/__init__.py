"""Incremental checks on streams."""

from depguard.streaming.order import check_stream
from depguard.streaming.drift import fd_stream_counts

__all__ = ["check_stream", "fd_stream_counts"]
