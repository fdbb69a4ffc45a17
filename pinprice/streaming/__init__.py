"""Structured Streaming jobs."""

from pinprice.streaming.requests import (
    current_prices,
    read_stream_results,
    read_updates,
    stream_merge_prices,
    stream_price_requests,
    write_updates,
)

__all__ = ["current_prices", "read_stream_results", "read_updates", "stream_merge_prices", "stream_price_requests",
           "write_updates"]
