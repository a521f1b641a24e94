"""Structured Streaming: the job queue and the job states."""
