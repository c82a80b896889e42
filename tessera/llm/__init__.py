"""Operations for preparing language-model training data."""
