"""Inputs: lines of files (plain or gzip) as JSON, logfmt or plain text, and tables with declared columns."""
