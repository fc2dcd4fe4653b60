"""Queries over the driver's tables, by operator id, with the SQL that checks them."""
