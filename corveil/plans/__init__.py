"""Part of corveil: plans."""
