"""Token ids of whole texts by a public word-level BPE, with memories for words and their parts."""

from __future__ import annotations

import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the pattern by which this vocabulary splits normalised text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
#: Words of these characters are composed already and split alike in every Unicode version; others go to the tokenizer whole.
PLAIN = r"[!-~¡-ſ]+"
END = "</w>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class LetterMerges:
    """The merges for parts made of letters, on a rank-based merger that knows bytes only.

    A part's last byte counts as another symbol than the same byte inside it. Lower-case Latin letters need few
    enough byte values for both kinds to be bytes: `inside` and `final` map them, and the vocabulary's tokens are
    translated alike, with their ids (which follow the order of the merges) as ranks."""

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        used = [*range(ord("a"), ord("z") + 1), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]
        free = [b for b in range(256) if b not in used]
        self.final = {b: f for b, f in zip((b for b in used if b < 0xC0), free)}
        self.letters = frozenset(used)
        self.last = bytes(self.final.get(b, b) for b in range(256))
        signs, ranks = _byte_signs(), {}
        for token, i in vocabulary.items():
            ended = token.endswith(END) and token != END
            raw = [signs.get(c) for c in (token[: -len(END)] if ended else token)]
            if raw and all(b in self.letters for b in raw) and (not ended or raw[-1] in self.final):
                ranks[bytes(raw[:-1]) + (bytes([self.final[raw[-1]]]) if ended else bytes(raw[-1:]))] = i
        for b in set(range(256)) - {k[0] for k in ranks if len(k) == 1}:
            ranks[bytes([b])] = (1 << 30) + b
        self.encode = tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, part: str) -> bytes | None:
        """Ids of a part, or None if it is not made of these letters."""
        raw = part.encode()
        if not self.letters.issuperset(raw) or raw[-1] not in self.final:
            return None
        ids = self.encode(raw[:-1] + self.last[raw[-1] : raw[-1] + 1])
        return np.array(ids, dtype="<u4").tobytes() if max(ids) < 1 << 30 else None


class TextIds:
    """Little-endian unsigned 32-bit ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    The tokenizer never joins across white space, so a text's ids are its words' ids in a row; ids of a word
    are kept, as are those of the parts into which the vocabulary's pattern splits words. Both memories are
    emptied beyond `most` entries."""

    def __init__(self, path: str, most: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.ascii_parts, self.plain = regex.compile(PARTS).findall, re.compile(ASCII_PARTS).findall, re.compile(PLAIN).fullmatch
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.most = most
        self.letters = LetterMerges(self.tokenizer.get_vocab(with_added_tokens=False))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        known, words = self.known, self.words
        for word in new:
            text = word.decode("utf-8", "replace")
            if not self.plain(text) or "<|" in text and any(x in text for x in self.special):
                words[word] = self._direct(text)
                continue
            out = []
            for x in self.ascii_parts(text.lower()) if text.isascii() else self.parts(text.lower()):
                ids = known.get(x)
                if ids is None:
                    known[x] = ids = self.letters(x) or self._direct(x)
                out.append(ids)
            words[word] = out[0] if len(out) == 1 else b"".join(out)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > self.most:
            self.words = {}
        if len(self.known) > self.most:
            self.known = {}
        get, out = self.words.get, []
        for text in texts:
            words = text.split()
            try:
                ids = b"".join(map(get, words))
            except TypeError:  # some word is new
                self._learn([w for w in dict.fromkeys(words) if w not in self.words])
                ids = b"".join(map(get, words))
            out.append(ids)
        return out
