"""A PySpark engine for branchable tables, typed merges, provenance and change feeds."""
