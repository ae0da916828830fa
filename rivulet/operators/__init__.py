"""Batch operators; most apply unchanged to streaming DataFrames."""
