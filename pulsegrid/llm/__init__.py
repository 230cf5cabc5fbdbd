"""Training-data operators: scans, near-duplicates, formatting, token files, scoring.

Nothing outside this subpackage imports it; the driver entry point adds its
queries only if the import succeeds.
"""
