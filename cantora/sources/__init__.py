"""Readers of note tables, MIDI files and recordings."""
