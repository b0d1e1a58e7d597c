"""Whole texts to token ids, each pre-token encoded by itself and once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import regex

from corvana.llm import batch_pieces


class TextEncoder:
    """Encodes whole texts, each match of a pattern by itself; encode gives the ids of a list of matches.

    Texts that follow the usual byte-level pattern are cut and looked up in numpy, a
    batch at a time; other patterns, and texts too long for that, go match by match.
    Ids are little-endian unsigned 32-bit integers.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], Sequence[Sequence[int]]]) -> None:
        self.pattern, self.list_encode = regex.compile(pattern), encode
        self.batch = batch_pieces.BatchEncoder(encode) if pattern == batch_pieces.PATTERN else None

    def encode(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        ids = dict(zip(kinds := list(dict.fromkeys(pieces)), (np.asarray(x, dtype="<u4").tobytes() for x in self.list_encode(kinds)), strict=True)) if pieces else {}
        return b"".join(map(ids.__getitem__, pieces))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if self.batch is None:
            return [self.encode(t or "") for t in texts]
        return self.batch.encode_many(texts, self.encode)
