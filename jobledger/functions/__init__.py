"""Part of jobledger."""
