"""New raw files as a stream."""

from adlake.streaming.files import run_stream, stream_to_bronze

__all__ = ["run_stream", "stream_to_bronze"]
