"""Reading and writing the files that documents come in."""
