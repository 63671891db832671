"""Streaming forms of message screening, conversation memory and upserts."""
