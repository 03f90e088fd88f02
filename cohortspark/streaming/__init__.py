"""Stream-driven use of the stateless operators."""
