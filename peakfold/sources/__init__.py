"""Readers of spectra files and the views over plain tables."""
