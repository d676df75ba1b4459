"""Reading and writing drifting delimited files."""
