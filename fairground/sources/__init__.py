"""Table readers, page extraction and write-side operators."""
