"""Column functions over canonical terms and IRIs."""
