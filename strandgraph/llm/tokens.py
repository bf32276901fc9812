"""Token ids of the public byte-level BPE, fast enough for whole corpora.

The vocabulary splits a text before merging, and a blank between two visible characters always
starts a new part. So ids of " word" don't depend on the neighbours, and each distinct word of a
batch is encoded once: all new words of a batch go to the encoder as one text, whose ids are cut
where a token starts with a blank. Texts with blanks in a row or blanks beside other white space
go to the encoder whole. So do texts with the vocabulary's special string, which gets its own id as
it does from the `tokenizers` library with add_special_tokens=False. Tests hold the ids against that.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Words kept per worker (some 150 bytes each).
CACHE_WORDS = 200_000
#: The string that the vocabulary takes as one token, and its id (fixed values).
SPECIAL = {"<|endoftext|>": 50256}
_ODD = re.compile(r"^\s| \s|\s $| $")


@lru_cache(1)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    starts = np.zeros(max(*ranks.values(), *SPECIAL.values()) + 1, bool)
    starts[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL), starts


class Tokens:
    """Ids as little-endian unsigned 16-bit bytes (the vocabulary has 50,257 entries)."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.encoding, self.starts = _encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint16).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), np.uint16)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(new):  # a word with white space that joins what follows
            self.cache.update((w, self._whole(" " + w)) for w in new)
            return
        flat = ids.tobytes()
        cuts = (2 * at).tolist() + [len(flat)]
        self.cache.update((w, flat[i:j]) for w, i, j in zip(new, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for at in range(0, len(texts), 64):
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            part = [None if not t or _ODD.search(t) or any(x in t for x in SPECIAL) else t.split(" ") for t in texts[at : at + 64]]
            self._learn({w for words in part if words for w in words[1:] if w})
            cache = self.cache
            for text, words in zip(texts[at : at + 64], part):
                if words is None:
                    yield self._whole(text) if text else b""
                else:
                    yield self._whole(words[0]) + b"".join([cache[w] for w in words[1:]])
