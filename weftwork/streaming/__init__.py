"""streaming of weftwork."""
