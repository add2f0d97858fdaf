"""Helpers that shape physical plans: tables that cut lineage, distributed ranks, and ASCII text normalisation."""
