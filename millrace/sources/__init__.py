"""Where values come from and are kept: file sources, table references, the value store."""
