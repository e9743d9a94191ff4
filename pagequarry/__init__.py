"""Batch and streaming jobs over archived web pages, responses, manifests and request logs."""
