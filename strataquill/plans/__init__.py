"""Plan builders: lineage cuts, fixpoints, revision expressions."""
