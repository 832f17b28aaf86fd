"""Readers, result sinks and versioned datasets."""
