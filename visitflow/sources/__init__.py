"""Readers and writers for sessions, tables, fitted parameters and reports."""
