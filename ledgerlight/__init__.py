"""Evidence analytics on Spark: revisions, document trees, retrieval, claims, detection and audits as DataFrame operators."""
