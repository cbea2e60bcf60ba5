"""Reads, writes and metadata as plain functions."""
