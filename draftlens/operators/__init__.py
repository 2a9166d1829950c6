"""operators of draftlens."""
