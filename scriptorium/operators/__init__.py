"""Operators on document tables and on the events of document processing."""
