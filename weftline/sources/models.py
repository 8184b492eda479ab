"""Interfaces of the outside models and services, with deterministic offline stand-ins.

The stand-ins make results reproducible; they do not have the quality of trained models."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np

from weftline.config import Agent


class Embedder(Protocol):
    def load(self) -> None: ...
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def load(self) -> None: ...
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Llm(Protocol):
    """settings: temperatures and token limit. prompt: the numbered context block; history: the last messages, (role, text)."""

    def load(self, settings: Agent) -> None: ...
    def relevant(self, question: str, text: str) -> str: ...
    def rewrite(self, question: str, history: list[tuple[str, str]]) -> str: ...
    def answer(self, question: str, context: list[str], prompt: str, history: list[tuple[str, str]]) -> str: ...
    def grounded(self, answer: str, context: list[str]) -> str: ...
    def answers(self, question: str, answer: str) -> str: ...
    def intent(self, question: str) -> str: ...


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class HashingEmbedder:
    """Signed feature hashing of words."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for w in _words(text):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        return out


class OverlapReranker:
    """Share of the question's words that the text holds, then shortness."""

    def load(self) -> None:
        pass

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            want, have = set(_words(q)), _words(t)
            out.append(len(want & set(have)) / max(1, len(want)) + 1.0 / (1000 + len(have)))
        return out


class ExtractiveLlm:
    """Answers by the sentences that share most words with the question."""

    #: What it reads is the texts themselves, so prompt and history change nothing.
    stop = frozenset("a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split())

    def load(self, settings: Agent = Agent()) -> None:
        pass

    def _content(self, text: str) -> set[str]:
        return set(_words(text)) - self.stop

    def relevant(self, question: str, text: str) -> str:
        return "yes" if self._content(question) & self._content(text) else "no"

    def rewrite(self, question: str, history: list[tuple[str, str]]) -> str:
        before = [w for _, t in history for w in _words(t) if w not in self.stop]
        new = [w for w in dict.fromkeys(before) if w not in _words(question)][:3]
        return " ".join([question, *new])

    def answer(self, question: str, context: list[str], prompt: str = "", history: list[tuple[str, str]] = ()) -> str:
        want = self._content(question)
        found = []
        for i, text in enumerate(context, 1):
            for j, s in enumerate(re.split(r"(?<=[.!?।])\s+", text)):
                if hits := len(want & self._content(s)):
                    found.append((-hits, i, j, f"{s.strip()} [{i}]"))
        return " ".join(x[3] for x in sorted(found)[:3]) or "The context does not say."

    def grounded(self, answer: str, context: list[str]) -> str:
        have, known = self._content(re.sub(r"\[\d+\]", "", answer)), self._content(" ".join(context))
        return "grounded" if not have or len(have & known) / len(have) >= 0.5 else "hallucinated"

    def answers(self, question: str, answer: str) -> str:
        return "yes" if self._content(question) & self._content(answer) else "no"

    def intent(self, question: str) -> str:
        words = set(_words(question))
        return "procedural" if "how" in words else "comparison" if words & {"compare", "versus", "vs"} else "eligibility" if words & {"eligible", "eligibility", "qualify"} else "factual"
