"""Part of the tidemark engine; see README.md."""
