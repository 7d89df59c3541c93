"""Functions over values: proofs, circuits and terms."""
