"""The registered queries: every operator over whole tables, with its SQL twin where SQL can say it."""
