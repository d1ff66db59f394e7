"""DataFrame -> DataFrame operators, grouped as in the survey (Q, F, P, C, B, G)."""
