"""Bytes of both layouts to Arrow and back. No Spark in here."""
