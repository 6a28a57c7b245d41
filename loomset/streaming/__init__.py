"""Structured Streaming: row-local operators run unchanged, idle streaks keep state."""
