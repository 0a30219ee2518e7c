"""Dataset curation on Spark: manifests, fingerprints, leak-free splits, audits and profiles."""
