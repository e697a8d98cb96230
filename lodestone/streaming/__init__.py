"""Structured Streaming: the batch operators' streaming counterparts over file sources."""
