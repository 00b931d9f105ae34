"""Training-data operators. Nothing outside this folder imports it, so it can be removed whole."""
