"""Readers and writers of the formats that the jobs exchange."""
