"""Streams of reflog lines and of landed packs."""
