"""Regex search and analytics over large text collections, as Spark plans."""
