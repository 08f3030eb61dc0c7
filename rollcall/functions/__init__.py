"""Column functions: text normalisation, compatibility of names, presentation."""
