"""Readers and writers of case documents, corpora and logs."""
