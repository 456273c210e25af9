"""Readers and writers of documents, vaults and delimited tables."""
