"""BPE encoding and decoding by a prefix-sharing trie traversal.

The BPE encoding of a string ends in exactly one token such that (a) what stands before it is
encoded as it would be alone and (b) no merge crosses the seam. So the last token of every prefix
can be found from the last tokens of shorter prefixes, and a prefix that many words share is
worked out once: the sorted distinct words are the depth-first order of their trie, and a stack
holds the last-token states along the path to the current node.

The tokenizer file is a parameter. It is read on the driver and travels to the executors inside
the task's closure as a broadcast value; it has a fixed size.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinloom.llm.text import slices, worker_cache

_BYTES = 256
_NEVER = 1 << 40
_SHORT = (2, 1)
#: The pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct text units that a worker keeps between batches.
CACHE_UNITS = 800_000
CACHE_CHARS = 64
#: Pairs of tokens whose seam a worker remembers.
CACHE_SEAMS = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(_BYTES) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(_BYTES + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE model with its last-token traversal. Instances are plain data."""

    def __init__(self, path: str, keep_seams: int = CACHE_SEAMS):
        self.keep_seams = keep_seams
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        self.key = uuid.uuid4().hex
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.rank, self.born, self.parts = {}, {i: -1 for i in self.bytes}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = (model["vocab"][x] for x in (a, b, a + b))
            self.rank[a, b] = r
            if c not in self.parts:
                self.born[c], self.parts[c] = r, (a, b)
        self.size = {i: len(b) for i, b in self.bytes.items()}
        # lengths of the tokens that end in given three bytes, longest first
        tails: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 2:
                tails.setdefault(b[-3:], set()).add(len(b))
        self.tails = {t: (*sorted(n, reverse=True), *_SHORT) for t, n in tails.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        # a token that its own bytes' merges would not build never ends a prefix
        self.whole = {b: i for b, i in self.ids.items() if len(b) == 1 or i in self.parts and self.apart(*self.parts[i], self.born[i])}

    def apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether no merge that runs before ``until`` crosses the seam of two encoded tokens.

        Walks back in time: of the two pieces at the seam the one built last is undone. A piece
        is there until the merge that takes it up; of equal merges the leftmost runs first.
        """
        left_until, right_until = until, until
        while True:
            r = self.rank.get((left, right), _NEVER)
            if r < left_until and r <= right_until and r < until:
                return False
            born_left, born_right = self.born[left], self.born[right]
            if born_left < 0 and born_right < 0:
                return True
            if born_right >= born_left:
                right_until, right = born_right, self.parts[right][0]
            else:
                left_until, left = born_left, self.parts[left][1]

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Walks the trie of distinct words depth first. At each word it gives the states along
        its path: the last token after each number of bytes, and the emitted tokens so far."""
        whole, seams, tails = self.whole, self.seams, self.tails
        if len(seams) > self.keep_seams:
            seams.clear()
        last, total, before = [-1], [0], b""
        for word in sorted(words):
            depth = 0
            for x, y in zip(word, before):  # noqa: B905  the shorter one ends the shared path
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], total[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                start = token = -1
                for length in tails.get(word[end - 3 : end], _SHORT) if end > 2 else _SHORT:
                    start = end - length
                    if start < 0:
                        continue
                    token = whole.get(word[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    seam = (last[start], token)
                    ok = seams.get(seam)
                    if ok is None:
                        ok = seams[seam] = self.apart(*seam)
                    if ok:
                        break
                last.append(token)
                total.append(total[start] + 1)
            yield word, last, total
            before = word

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, read back from the last tokens along each path."""
        out, size = {}, self.size
        for word, last, _ in self.walk(words):
            tokens, end = [], len(word)
            while end:
                tokens.append(token := last[end])
                end -= size[token]
            out[word] = tokens[::-1]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


#: A piece of text that its neighbours can't change: what it begins with, a blank or a line end
#: after another character, always begins a new pre-token. Other white space takes the long way.
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]|\x85")


def _cut(model: Bpe, text: str) -> list[tuple[str, bool]]:
    """(piece, is special) where special tokens stand in the text."""
    if not any(t in text for t in model.special):
        return [(text, False)]
    found = re.split("(" + "|".join(re.escape(t) for t in sorted(model.special, key=len, reverse=True)) + ")", text)
    return [(x, bool(i % 2)) for i, x in enumerate(found) if x]


def units_of(text: str) -> list[str]:
    return [text] if _ODD.search(text) else _UNIT.findall(text)


def encode_units(model: Bpe, units: list[str]) -> list[list[int]]:
    """Token ids of units, their pre-tokens encoded together."""
    find = regex.compile(PATTERN).findall
    split = [[w.encode() for w in find(u)] for u in units]
    coded = model.encode_words(list({w for ws in split for w in ws}))
    return [[t for w in ws for t in coded[w]] for ws in split]


def look_up(model: Bpe, cache: dict, texts: list[list[str]], make, keep: int) -> dict:
    """Makes ``cache`` hold every unit of ``texts``; returns it, or a view with units too long
    to keep. ``make`` gives a unit's entry from its ids; above ``keep`` entries it starts anew."""
    if len(cache) > keep:
        cache.clear()
    new = list({u for units in texts for u in units if u not in cache})
    here = dict(zip(new, map(make, encode_units(model, new)), strict=True))
    if any(len(u) > CACHE_CHARS for u in new):
        return _Both(cache, here)
    cache.update(here)
    return cache


class _Both(dict):
    def __init__(self, cache: dict, here: dict):
        super().__init__(here)
        cache.update((u, e) for u, e in here.items() if len(u) <= CACHE_CHARS)
        self.rest = cache

    def __missing__(self, u: str):
        return self.rest[u]


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, keep_units: int = CACHE_UNITS, keep_seams: int = CACHE_SEAMS) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, token_ids to (doc_id, text).

    Special tokens in a text are encoded as such, no others are added. A null text is empty: no
    tokens, and the hashes are those of the empty string. Each row is encoded by itself, so
    repeated rows repeat; other columns of ``docs`` are left out; an empty table stays empty.
    ``keep_units`` and ``keep_seams`` bound what a worker remembers: less memory for more time.
    """
    model = docs.sparkSession.sparkContext.broadcast(Bpe(path or tokenizer_path(), keep_seams))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")

    def run(batches):
        bpe = model.value
        cache = worker_cache("encode", bpe.key)

        def make(tokens):
            packed = np.array(tokens, np.int32).tobytes() if ids else b""
            return len(tokens), ",".join(map(str, tokens)), b"".join([bpe.bytes[t] for t in tokens]), packed

        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column, 4 << 20):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                # of each text the special tokens as strings, the rest as lists of units
                cut = [[p if special else units_of(p) for p, special in _cut(bpe, t)] for t in texts]
                known = look_up(bpe, cache, [p for pieces in cut for p in pieces if isinstance(p, list)], make, keep_units)
                rows = []
                for pieces in cut:
                    got = []
                    for piece in pieces:
                        got += map(known.__getitem__, piece) if isinstance(piece, list) else [make([bpe.special[piece]])]
                    listed = ",".join([g[1] for g in got if g[0]])
                    text = b"".join([g[2] for g in got])
                    try:
                        text.decode()
                    except UnicodeDecodeError:
                        text = text.decode("utf-8", "replace").encode()
                    rows.append((sum([g[0] for g in got]), sha256(listed.encode()).hexdigest(), sha256(text).hexdigest(), b"".join([g[3] for g in got])))
                columns = [batch.column(0).slice(a, b - a), *[pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))]]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join([r[3] for r in rows]), np.int32))
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *[r[0] for r in rows]]).astype(np.int32), flat))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids), as ``encode`` gives them. Null ids give a null text, no ids an empty
    one; bytes that are no UTF-8 give replacement characters; a null doc_id is carried, repeated rows repeat, an empty table
    stays empty, a text of any length is decoded whole, and other columns go, whatever their names."""
    model = encoded.sparkSession.sparkContext.broadcast(Bpe(path or tokenizer_path()))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": [None if t is None else model.value.decode(list(t)) for t in frame["token_ids"]]})

    return encoded.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInPandas(run, "doc_id long, text string")


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path, ids=False)
