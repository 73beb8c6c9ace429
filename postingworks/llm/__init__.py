"""Training-data operators on texts, vectors and conversations; nothing else in the library imports this package."""
