"""Event time, windows and sinks for streams."""
