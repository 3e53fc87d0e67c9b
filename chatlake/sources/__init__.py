"""Reading and writing message data."""
