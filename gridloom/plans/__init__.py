"""End-to-end flows composed of operators."""
