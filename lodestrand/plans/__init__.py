"""The query catalogue: operators applied to whole tables, with their SQL."""
