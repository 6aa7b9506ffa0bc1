"""Training-data operators.  Nothing outside this subpackage (but the entry file) imports it."""
