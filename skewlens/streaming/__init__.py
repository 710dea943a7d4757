"""Structured Streaming forms of the class-balance and feature operators."""
