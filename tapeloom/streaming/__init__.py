"""The incremental forms of bars, top of book and bar storage, as Structured Streaming."""

from tapeloom.streaming.jobs import bar_upsert, drain, time_bars, top_of_book

__all__ = ["bar_upsert", "drain", "time_bars", "top_of_book"]
