"""Readers and writers: raw records, dataset bundles, generated rows, results, runs."""
