"""Token ids of whole texts with the installed tokenizer libraries.

``WordEncoder`` serves vocabularies that drop white space, so that the ids of a text are the ids of
its white-space-delimited chunks in a row. Each chunk is encoded once per worker and remembered;
the memory has a bound, beyond which it starts anew with the same results.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from treesift.llm.common import split_words

# A run of ASCII marks at a chunk's end, after an ASCII letter or digit.
_RUN = re.compile(rb"(.*[a-z0-9])([.,;:!?*#$%&)]+)\Z", re.S)
_MARKS = frozenset(b".,;:!?*#$%&)")
_KEPT = 700_000
# Chunks given to the tokenizer as one text.
_GROUP = 200


class WordEncoder:
    """Ids by the tokenizers library, exactly those of encoding whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = max(self._tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._known: dict[bytes, bytes] = {}  # packed ids by chunk
        added = [(i, t.content) for i, t in self._tokenizer.get_added_tokens_decoder().items() if "<|" in t.content]
        self._mark = min(added, default=None)

    def _packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; special tokens are matched before lower-casing."""
        found: list[bytes] = []
        for k in range(0, len(words), _KEPT // 4):
            part = words[k : k + _KEPT // 4]
            if len(self._known) > _KEPT:
                self._known.clear()
            special = b"<|" in b" ".join(part)
            keys = [w if b"<|" in w else w.lower() for w in part] if special else list(map(bytes.lower, part))
            self._learn([w for w in dict.fromkeys(keys) if w not in self._known])
            found += map(self._known.__getitem__, keys)
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks; marks behind a word are pre-tokens of their own, so that words and marks are known apart."""
        parts, pieces = {}, {}
        for chunk in chunks:
            m = _RUN.match(chunk) if chunk[-1] in _MARKS and b"<|" not in chunk else None
            if m:
                parts[chunk] = found = m.groups()
                pieces |= dict.fromkeys(found)
            else:
                pieces[chunk] = None
        pieces = [x for x in pieces if x not in self._known]
        # An added token parts pieces exactly: what stands between two of them is encoded by itself.
        together = [x for x in pieces if b"<|" not in x] if self._mark else []
        alone = [x for x in pieces if b"<|" in x] if self._mark else pieces
        for x, e in zip(alone, self._tokenizer.encode_batch_fast([x.decode() for x in alone], add_special_tokens=False)):
            self._known[x] = np.array(e.ids, self.dtype).tobytes()
        groups = [together[k : k + _GROUP] for k in range(0, len(together), _GROUP)]
        if groups:
            mark, between = self._mark
            texts = [between.join(map(bytes.decode, group)) for group in groups]
            width = self.dtype.itemsize
            for group, e in zip(groups, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = [*(np.flatnonzero(ids == mark) * width).tolist(), len(ids) * width]
                raw, start = ids.tobytes(), 0
                for x, end in zip(group, ends):
                    self._known[x] = raw[start:end]
                    start = end + width
        for chunk, (word, marks) in parts.items():
            self._known[chunk] = self._known[word] + self._known[marks]

    def encode_all(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """The packed ids of each text, ``end_id`` last. Different words are encoded once."""
        values, offsets = split_words(texts)
        coded = values.dictionary_encode()
        packed = self._packed(coded.dictionary.cast(pa.binary()).to_pylist()).__getitem__
        words, bounds = coded.indices.to_numpy(zero_copy_only=False).tolist(), offsets.tolist()
        end = np.array([end_id], self.dtype).tobytes()
        return [b"".join(map(packed, words[a:b])) + end for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    return WordEncoder(path)


class SpanEncoder:
    """Byte-level ids with the byte span of each token, from a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self._sizes[i] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offset at which each token ends."""
        ids = np.asarray(self._encoding.encode_ordinary(text), dtype=np.int64)
        return ids, np.cumsum(self._sizes[ids]) if len(ids) else np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=4)
def span_encoder(path: str, pattern: str) -> SpanEncoder:
    return SpanEncoder(path, pattern)
