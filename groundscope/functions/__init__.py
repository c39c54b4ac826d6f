"""Column-to-Column functions: text normalisation, phrases, scalar surface, encoders."""
