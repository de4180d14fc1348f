"""Scans of landed inventory, event and code files; snapshot, log and report sinks."""
