"""Whole questions over a catalogue: duplicates, retention, layout, statistics."""
