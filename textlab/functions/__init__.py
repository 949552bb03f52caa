"""Column functions: text normalisation and tokens, distances and alignments."""
