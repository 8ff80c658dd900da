"""Readers and writers of timed text: captions, transcripts, indexes and manifests."""
