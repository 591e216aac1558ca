"""Readers that turn listings, folders, archives and pages into tables."""
