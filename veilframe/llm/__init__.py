"""Training-data operators: ten corpus-scale jobs, each usable on its own."""
