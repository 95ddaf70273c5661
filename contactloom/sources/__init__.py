"""Readers of logs, texts and archives."""
