"""Readers: project tables, path rules, mailmaps, blame text, source trees."""
