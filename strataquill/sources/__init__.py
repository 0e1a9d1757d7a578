"""Readers and writers of stored forms: packs and their indexes, graphs, ref files, logs, bundles, archives."""
