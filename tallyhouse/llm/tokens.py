"""Token ids of whole texts by a public byte-level BPE tokenizer file.

The ids are those of the file in the `tokenizers` library. As merges in such a file are numbered in the order in which they apply, the
same ids follow from the vocabulary as ranks, which `tiktoken` does about four times as fast; the tests compare the two.
A text that it refuses goes to `tokenizers`.
"""

from __future__ import annotations

import json

import numpy as np

# Fixed value: how a byte-level tokenizer cuts a text before it merges.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable characters by which a vocabulary file names bytes: printable bytes name themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, without special tokens; their names in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model.get("added_tokens", [])}
        names = byte_names()
        ranks = {bytes(names[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = path, None

    def ids(self, text: str) -> bytes:
        try:
            found = self.fast.encode_ordinary(text)
        except BaseException as refusal:  # the library's panics are no Exceptions
            if isinstance(refusal, KeyboardInterrupt | SystemExit | GeneratorExit):
                raise
            found = self.exact(text)
        return np.array(found, dtype="<u4").tobytes()

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids
