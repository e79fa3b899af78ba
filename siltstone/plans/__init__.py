"""Storage planning: catalog, manifests, compaction and query entry points."""
