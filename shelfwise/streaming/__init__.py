"""The event-driven operators as Structured Streaming queries."""
