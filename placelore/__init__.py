"""Preference memory over place-interaction logs, expressed as PySpark DataFrame jobs."""
