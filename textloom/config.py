"""Settings of analysis and ranking."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms: tokenise, lower-case, drop stop words, stem, in this order."""

    stop: bool = False
    stem: bool = False
    tokenizer: str = "alpha"
    words: tuple[str, ...] | None = None

    @property
    def name(self) -> str:
        return {(False, False): "base", (True, False): "stop", (False, True): "stem", (True, True): "stopstem"}[self.stop, self.stem]


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75


BASE, STOP, STEM, STOP_STEM = Analyzer(), Analyzer(stop=True), Analyzer(stem=True), Analyzer(stop=True, stem=True)
