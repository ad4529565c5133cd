"""Readers and writers: media files, archives, documents, the versioned store, spreadsheets."""
