"""Versioned tables, their log, file formats and the catalog."""
