"""Reading tables and messages, writing tables and events."""
