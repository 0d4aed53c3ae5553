"""Whole pipelines composed from the operators; each is one lazy plan."""
