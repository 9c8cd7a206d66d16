"""Crawl-corpus engine: page discovery, filtering, language dedupe, robots and quota
gating and text export, expressed as DataFrame and Structured Streaming jobs."""
