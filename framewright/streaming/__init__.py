"""Frames as streams: tables replayed in order, and rules that carry state."""
