"""Column functions: code points, regular expressions, entropy, mutations."""
