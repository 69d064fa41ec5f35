"""Sources: CSV extraction with a schema contract, typed raw tables, test binding."""
