"""The stages of the news flow, composed from the operators."""
