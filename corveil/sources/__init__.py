"""Part of corveil: sources."""
