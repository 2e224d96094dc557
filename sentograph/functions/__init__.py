"""Column functions, gathered for import."""

from sentograph.operators.corpus import annotations, architecture, homopolymer, tokens, true_length, with_ends
from sentograph.operators.ngrams import seeded_windows, windows
from sentograph.operators.stats import drawn_before, upper_normal

__all__ = ["annotations", "architecture", "drawn_before", "homopolymer", "seeded_windows", "tokens", "true_length", "upper_normal", "windows", "with_ends"]
