"""Change events: batch forms and Structured Streaming jobs."""
