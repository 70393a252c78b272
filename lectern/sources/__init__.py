"""Where documents and libraries come from and where decks go."""
