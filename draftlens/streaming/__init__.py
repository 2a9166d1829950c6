"""streaming of draftlens."""
