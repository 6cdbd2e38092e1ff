"""Structured Streaming versions of scoring and drift monitoring."""
