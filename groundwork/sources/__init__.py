"""Part of groundwork."""
