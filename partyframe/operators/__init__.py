"""Operators: plain functions DataFrame -> DataFrame."""
