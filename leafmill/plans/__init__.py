"""Composed jobs: rendering of parsed documents and step workflows."""
