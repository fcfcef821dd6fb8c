"""Jobs: the analyses a user calls.  Each returns a lazy DataFrame."""
