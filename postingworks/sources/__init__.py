"""Job boards: fetching, and parsing of what they send."""
