"""Structured Streaming: runners, keyed state, timers and metrics."""
