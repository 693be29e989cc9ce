"""Streams: the engine reads its inputs to their end, so there are no stream operators; its tables can be read by Structured Streaming as any others."""
