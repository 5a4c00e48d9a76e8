"""Whole runs: from texts to proposals, from texts to findings, from decisions to edited texts."""
