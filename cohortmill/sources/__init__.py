"""Readers, writers and configuration loaders."""
