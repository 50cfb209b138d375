"""Operators over data frames: each takes frames and column names and returns a frame."""
