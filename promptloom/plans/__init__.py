"""Registered queries: each a plan over the test tables with its SQL twin."""
