"""plans of draftlens."""
