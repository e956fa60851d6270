"""Bulk identity-document verification analytics, written as Spark DataFrame transformations."""
