"""Landed-file scans and sinks, HTML extraction."""
