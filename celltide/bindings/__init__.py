"""Registered queries over star-schema tables that play the roles of events, labels and signals."""
