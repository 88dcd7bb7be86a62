"""Column functions and fixed tables of note analytics."""
