"""Spark jobs over large collections of recording transcripts."""
