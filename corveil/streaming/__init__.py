"""Part of corveil: streaming."""
