"""Training-data operators (text, pages, archives).  Nothing else in the library imports this package."""
