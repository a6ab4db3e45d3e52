"""Training-data operators: ten document operators for corpora, each usable on its own."""
