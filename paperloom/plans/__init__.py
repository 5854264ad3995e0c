"""Helpers that cut plans into stages and ship code to workers."""
