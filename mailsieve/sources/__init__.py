"""Scans and table builders."""
