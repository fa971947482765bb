"""Event files as a stream."""
