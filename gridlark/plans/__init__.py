"""Registered queries, their views over the driver tables, and the SQL that checks them."""
