"""Where corpora come from and where derived tables go."""
