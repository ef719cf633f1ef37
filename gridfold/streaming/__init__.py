"""Append landed page files to a dataset as they arrive."""

from gridfold.streaming.append import appended_count, read_appended, stream_append

__all__ = ["appended_count", "read_appended", "stream_append"]
