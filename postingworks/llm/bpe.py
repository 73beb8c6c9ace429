"""BPE encoding and decoding with a word-level vocabulary file of the tokenizers library.

Each word is merged in a contiguous rank array: the parts of the word and, beside them, the rank of each adjacent pair;
the minimum is found by a scan, its boundary deleted and the two neighbouring ranks refreshed. Words longer than
`LONG_WORD` parts keep their ranks in a heap, with the same result. Results are kept in a cache of bounded size.

Supported are files with the NFC, white space and lower-case normalizers and a split pattern before byte-level
characters, or any of these; special strings are recognised in raw texts, and nothing is added. Defined results: a null
or empty text has no ids and decodes to the empty string; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .packing import byte_alphabet

LONG_WORD = 256
CACHED_WORDS = 1 << 18
_NO_RANK = 1 << 60
#: Fixed value: Unicode's white space.
_SPACES = "\t-\r \x85\xa0  -     　"


class WordCodec:
    """Texts to ids and back for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self._suffix = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        char_of = {b: c for c, b in byte_alphabet().items()}
        self._inner = [vocab[char_of[b]] for b in range(256)]
        self._final = [vocab[char_of[b] + self._suffix] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        if spec.get("decoder"):
            raise ValueError("only files without a decoder are supported: tokens are joined by single spaces")
        steps = spec["normalizer"]["normalizers"] if (spec.get("normalizer") or {}).get("type") == "Sequence" else [x for x in [spec.get("normalizer")] if x]
        if unknown := {x["type"] for x in steps} - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {unknown} are not supported")
        self._steps = [x["type"] for x in steps]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(pattern.replace(r"\s", _SPACES))
        self._blank = regex.compile(f"[{_SPACES}]+")
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._cache = _Cache(self)

    def merged(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        raw = word.encode("utf-8")
        parts = [self._inner[b] for b in raw[:-1]] + [self._final[raw[-1]]]
        return tuple(self._by_heap(parts) if len(parts) > LONG_WORD else self._by_scan(parts))

    def _by_scan(self, parts: list[int]) -> list[int]:
        pairs, none = self._pairs, (_NO_RANK, 0)
        ranks = [pairs.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        pairs, n = self._pairs, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(found[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := pairs.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = pairs[a, b][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := pairs.get((parts[k], parts[after[k]]))):
                    heapq.heappush(heap, (found[0], k, parts[k], parts[after[k]]))
        return [x for x, keep in zip(parts, alive) if keep]

    def _normal(self, text: str) -> str:
        for step in self._steps:
            if step == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step == "Replace":
                text = self._blank.sub(" ", text)
            else:  # each character by itself: no final sigma
                text = text.replace("Σ", "σ").lower()
        return text

    def encode(self, text: str) -> list[int]:
        parts = self._split.split(text) if self._split and any(s in text for s in self.special) else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                ids += chain.from_iterable(map(self._cache.__getitem__, self._words.findall(self._normal(part))))
        return ids

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class _Cache(dict):
    def __init__(self, codec: WordCodec):
        self._codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self._codec.merged(word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


@lru_cache(2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", with_decoded: bool = True) -> DataFrame:
    """Per row: key, ids (array<int>) and, if asked for, decoded, which is made from the ids alone."""
    kind = docs.schema[key].dataType.simpleString()

    def encoded(batches):
        c = codec(tokenizer)
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if with_decoded:
                    out.append(pa.array([c.decode(x) for x in ids], pa.string()))
                yield pa.record_batch(out, names=[key, "ids", "decoded"][: len(out)])

    return docs.select(F.col(key), F.col(text)).mapInArrow(encoded, f"`{key}` {kind}, ids array<int>" + ", decoded string" * with_decoded)
