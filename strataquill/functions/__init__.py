"""Column functions: object ids, identities, paths, refs, dates, lines, and codecs behind pandas UDFs."""
