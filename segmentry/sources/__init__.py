"""Readers and writers of the formats that the pipelines exchange."""
