"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

#: The vocabulary, by its name among the public tokenizer files, as JSON and as ranks.
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """encode(text): the ids that `tokenizers` gives with add_special_tokens=False, as bytes.

    tiktoken holds the same vocabulary as ranks, cuts by the same pattern and is faster; a text goes
    to it whole, in one call, so nothing is kept from one text to the next. A text with the string
    of a special token goes to `tokenizers`.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json_path = json_path
        #: Ids lie below this; the one beyond the ranks is the special token's.
        self.size = max(ranks.values()) + 2
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @lru_cache(maxsize=1)  # noqa: B019
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        ids = self.whole().encode(text, add_special_tokens=False).ids if "<|endoftext|>" in text else self.plain(text)
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One per Python worker, for all tasks of that worker."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN)
