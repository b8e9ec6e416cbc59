"""Readers for image folders, ordered uploads and file metadata."""
