"""Registered queries: operators applied to tables, each beside equivalent SQL where there is any."""
