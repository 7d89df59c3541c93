"""Stable models: grounding, simplification, solving and what surrounds them."""
