"""Readers and writers of sequence and table formats."""
