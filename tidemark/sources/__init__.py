"""Readers, landing, exports and the feature store on disk."""
