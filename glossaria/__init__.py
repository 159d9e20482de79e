"""Vocabulary flashcards as Spark jobs, from a prompt and a word list to rendered cards."""
