"""Relational, graph and text operators over content-addressed tables."""
