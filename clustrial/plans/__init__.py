"""The analyses users run, composed from the operators."""
