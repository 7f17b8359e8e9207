"""Emberframe: DataFrame operators for gridded environmental risk data."""
