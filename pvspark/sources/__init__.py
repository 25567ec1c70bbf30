"""Readers (``trees``, ``tables``) and writers (``sinks``)."""
