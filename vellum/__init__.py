"""vellum: versioned hierarchical documents on Spark (ingest, graph tables, retrieval, evaluation, data quality)."""
