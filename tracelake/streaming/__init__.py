"""Streams: replay and tail, file following, windows, bounded matches."""
