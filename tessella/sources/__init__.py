"""Readers and writers of split lists, label files, logs and configurations."""
