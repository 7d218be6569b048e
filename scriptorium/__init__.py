"""scriptorium: document ingestion and text analytics written for Spark."""
