"""Structured Streaming. The pipeline itself is batch; this is an addition for variants that arrive continuously."""
