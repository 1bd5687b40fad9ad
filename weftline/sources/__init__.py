"""Bundles, volumes and shapes as tables."""
