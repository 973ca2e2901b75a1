"""Operators: filters, ranking, threads, digest blocks, stored summaries, chat, generation."""
