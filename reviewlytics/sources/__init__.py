"""Readers and writers: review files, raw CSVs, the five tables, mined exports."""
