"""functions of draftlens."""
