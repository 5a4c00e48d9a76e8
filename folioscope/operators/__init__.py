"""Operators over tables of scenes, spans, decisions and runs."""
