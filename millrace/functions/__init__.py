"""Identity of keys and values: canonical encoding, stable hashes, fingerprints, interning."""
