"""Incremental state: watermark, queue and streaming sinks."""
