"""Structured Streaming: debounced file events, throttled progress."""
