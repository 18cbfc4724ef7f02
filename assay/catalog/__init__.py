"""The registered queries: each applies one operator to whole tables, with its SQL beside it."""
