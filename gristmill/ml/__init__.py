"""Training, evaluation and prediction."""
