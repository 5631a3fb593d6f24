"""Scans and parsers: parquet telemetry lakes and text / CSV / JSON telemetry formats."""
