"""Reusable plan shapes: lineage cuts, sliced groups, ordered scans, vector matching."""
