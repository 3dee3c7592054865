"""Part of corveil: functions."""
