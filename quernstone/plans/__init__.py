"""Registered queries: operators applied to tables, with the SQL that checks them."""
