"""Readers and writers: relations, histograms and keyed containers."""
