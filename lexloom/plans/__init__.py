"""Iterative jobs and the plan helpers they share."""
