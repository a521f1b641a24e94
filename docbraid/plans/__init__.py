"""Whole plans: the translation flow, and every query with its SQL."""
