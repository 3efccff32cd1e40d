"""Fitted operators applied to streaming DataFrames."""
