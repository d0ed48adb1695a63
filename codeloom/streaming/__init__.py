"""Streaming: detectors over sources as they arrive."""
