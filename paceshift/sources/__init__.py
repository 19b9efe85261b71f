"""Reading and writing tables under declared schemas."""
