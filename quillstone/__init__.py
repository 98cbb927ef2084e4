"""Quillstone: text-quality analytics on Spark."""
