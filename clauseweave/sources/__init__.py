"""Readers and writers: annotated datasets, filings on disk, PDFs, the clause store."""
