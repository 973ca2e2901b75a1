"""Whole jobs: message threads, daily digest, summaries, answers."""
