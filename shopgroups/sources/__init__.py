"""Readers, writers and the views that map driver tables onto the retail model."""
