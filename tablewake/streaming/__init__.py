"""The audit as a stream of event files."""
