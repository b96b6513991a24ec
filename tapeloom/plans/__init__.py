"""Layouts that turn "ordered by time within one series" into evenly sized parallel tasks."""
