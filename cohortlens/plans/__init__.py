"""The three user-facing runs, composed of operators."""
