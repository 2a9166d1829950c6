"""sources of draftlens."""
