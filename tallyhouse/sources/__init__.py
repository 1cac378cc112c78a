"""Where data comes from and goes to: mappings, extracts, written tables, the audit log."""
