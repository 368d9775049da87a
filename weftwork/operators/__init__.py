"""operators of weftwork."""
