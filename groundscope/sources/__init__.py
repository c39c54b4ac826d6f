"""Readers and writers: tables, benchmark files, knowledge stores and run captures."""
