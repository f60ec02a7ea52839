"""Sessions that arrive as files, run through a fitted pipeline."""
