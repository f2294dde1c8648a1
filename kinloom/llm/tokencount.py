"""Token counts by a compiled finite-state tokenizer.

The transducer reads a text character by character, without looking ahead. Whatever has been read,
the sum of its transitions' annotations is the number of tokens of the text up to there. A state is

* what the pre-tokenizer knows: in a run of letters, of digits or of other marks, after an
  apostrophe that may begin a contraction, after a contraction, or in white space, whose last
  character is kept apart since it may belong to the next pre-token, and
* the last-token state of the open pre-token: for each of its last bytes that a longer token may
  begin with, the last token before them and the tokens emitted since. A byte's transition picks
  the longest token that may end there, so its annotation is one less the tokens that it takes back.

Both are finite: tokens have a greatest length. States and transitions are compiled when a text first
needs them; a transition over several characters is the composition of theirs and is kept as well.

Texts longer than ``chunk`` characters are read in chunks, each a row that any task may take. A
chunk's state map, state -> (state, count), has three parts: ``head``, the text up to the first white
space after another character, where all states meet; ``body``, the count from there on; ``tail``, the
text from the last such place, which leads the initial state to the chunk's last one. In a chunk where
states don't meet, all of it is head and body is null. A special token is a map too: it counts one and
leads every state to the initial one. Maps compose associatively, and a text's maps are composed as a
balanced tree; a value holds at most 2 GB, so a text has at most 2 GB / ``chunk`` maps of a few words
each. Only a text without white space keeps its heads, and then one task reads all of that text.
"""

from __future__ import annotations

import gc
import re

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.bpe import Bpe, _cut, tokenizer_path
from kinloom.llm.text import slices, worker_cache

#: Characters of a chunk.
CHUNK = 1 << 16
#: Transitions over one character and over several that a worker keeps, and the latter's characters.
KEEP_SINGLE, KEEP_COMPOSED, KEEP_CHARS = 600_000, 600_000, 48
#: What follows an apostrophe in a contraction of byte-level BPE's pre-tokenizer.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
#: Stretches that end with blanks, so that they begin in few states.
_STRETCH = re.compile(r"[^ \n]*[ \n]+|[^ \n]+")
#: All states meet after white space that follows another character.
_MEET = regex.compile(r"(?<=\S)\s")
_LAST_MEET = regex.compile(r"(?r)(?<=\S)\s")
_BYTE = [bytes((i,)) for i in range(256)]
_SPACE, _LETTER, _NUMBER = (regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}"))


class State(dict):
    """A state and its transitions: text -> (next state, count). ``mode`` is the pre-tokenizer's part, ``tokens``
    the open pre-token's last-token state, ``held`` the character that white space or a contraction holds."""

    __slots__ = ("machine", "mode", "tokens", "held")

    def __init__(self, machine: Machine, mode: str, tokens: tuple, held: str):
        self.machine, self.mode, self.tokens, self.held = machine, mode, tokens, held

    def __missing__(self, text: str) -> tuple[State, int]:
        m = self.machine
        if len(text) == 1:
            step = self[text] = m.step(self, text)
            m.single += 1
            return step
        step = m.read(self, text)
        if len(text) <= KEEP_CHARS:
            # units that end alike share their step
            self[text] = m.steps.setdefault((id(step[0]), step[1]), step)
            m.owners[id(self)] = self
            m.composed += 1
        return step


class Machine:
    """The transducer of a byte-level BPE model."""

    def __init__(self, model: Bpe):
        self.model, self.kinds = model, {}
        self.begins = {t[:i] for t in model.whole for i in range(1, len(t))}
        #: No token yet: any token may begin here.
        self.none = ((b"", -1, 0),)
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.first: dict[str, tuple[State, int]] = {}
        self.owners: dict[int, State] = {}
        self.steps: dict[tuple[int, int], tuple[State, int]] = {}
        self.single = self.composed = 0
        self.start = self.state("closed", self.none)

    def forget(self) -> None:
        """Drops compositions, or all states, of which more are kept than a worker should hold."""
        if self.composed > KEEP_COMPOSED:
            for s in self.owners.values():
                for text in [t for t in s if len(t) > 1]:
                    del s[text]
            self.owners, self.steps, self.composed = {}, {}, 0
        if self.single > KEEP_SINGLE:
            for s in self.states.values():
                s.clear()
            self.restart()
        if len(self.model.seams) > self.model.keep_seams:
            self.model.seams.clear()

    def state(self, mode: str, tokens: tuple, held: str = "") -> State:
        key = mode, tokens, held
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, mode, tokens, held)
        return found

    def kind(self, ch: str) -> str:
        found = self.kinds.get(ch)
        if found is None:
            found = self.kinds[ch] = "space" if _SPACE.match(ch) else "letters" if _LETTER.match(ch) else "numbers" if _NUMBER.match(ch) else "marks"
        return found

    def feed(self, tokens: tuple, text: str) -> tuple[tuple, int]:
        """The last-token state after ``text`` in the same pre-token, and the change of its count."""
        whole, begins, seams, count = self.model.whole, self.begins, self.model.seams, 0
        for b in text.encode():
            token, kept = None, []
            for seen, last, since in tokens:  # longest first
                seen += _BYTE[b]
                if token is None and (longest := whole.get(seen)) is not None:
                    ok = last < 0 or seams.get((last, longest))
                    if ok is None:
                        ok = seams[last, longest] = self.model.apart(last, longest)
                    if ok:
                        token, more = longest, 1 - since
                if seen in begins:
                    kept.append((seen, last, since))
            if more:
                kept = [(seen, last, since + more) for seen, last, since in kept]
            tokens = (*kept, (b"", token, 0))
            count += more
        return tokens, count

    def fresh(self, text: str) -> tuple[State, int]:
        """The state after a pre-token's first characters, a blank at most and another, and their count; or after white space."""
        found = self.first.get(text)
        if found is None:
            kind, held = self.kind(text[-1]), ""
            tokens, n = self.feed(self.none, text)
            if text == "'":
                kind = "apostrophe"
            elif kind == "space":
                tokens, held = self.none, text
            found = self.first[text] = self.state(kind, tokens, held), n
        return found

    def step(self, s: State, ch: str) -> tuple[State, int]:
        """One character's transition."""
        mode, tokens, kind = s.mode, s.tokens, self.kind(ch)
        if kind == "space":
            if mode != "space":
                return self.fresh(ch)
            run, _ = self.feed(tokens, s.held)
            return self.state("space", run, ch), self.feed(run, ch)[1]
        if mode == "space":  # the held character leaves the run
            back = self.feed(tokens, s.held)[1]
            if s.held == " ":
                to, n = self.fresh(" " + ch)
                return to, n - back
            to, n = self.fresh(ch)
            return to, n + self.fresh(s.held)[1] - back
        if mode == "short":  # an apostrophe, and a letter that may go on to a contraction
            if LONG[s.held] == ch:
                apostrophe, _ = self.feed(self.none, "'")
                return self.start, self.feed(apostrophe, s.held + ch)[1] - self.fresh(s.held)[1]
            mode = "letters"
        if mode == "apostrophe":
            if ch in SHORT:
                return self.start, self.feed(tokens, ch)[1]
            if ch in LONG:
                letter, n = self.fresh(ch)
                return self.state("short", letter.tokens, ch), n
            mode = "marks"
        if kind == mode:
            more, n = self.feed(tokens, ch)
            return self.state(mode, more), n
        return self.fresh(ch)

    def read(self, s: State, text: str) -> tuple[State, int]:
        """From a state over a text: (state, count)."""
        n = 0
        for ch in text:
            s, more = s[ch]
            n += more
        return s, n

    def run(self, s: State, text: str) -> tuple[State, int]:
        """As ``read``, by kept compositions."""
        n = 0
        for part in _STRETCH.findall(text):
            s, more = s[part]
            n += more
        return s, n


#: The state map of a special token.
SPECIAL = ("", 1, "")
#: That of an empty text.
EMPTY = ("", None, "")


def map_of(m: Machine, text: str) -> tuple[str, int | None, str]:
    """The state map (head, body, tail) of a text."""
    meet = _MEET.search(text)
    if not meet:
        return text, None, ""
    at = meet.end()
    last = _LAST_MEET.search(text).start()
    return text[:at], m.run(m.run(m.start, text[at - 1 : at])[0], text[at:])[1], text[last:]


def then(m: Machine, a: tuple, b: tuple) -> tuple[str, int | None, str]:
    """The map of ``a``'s text followed by ``b``'s."""
    if a[1] is None:  # a's states haven't met: its text is all there
        head, body, tail = map_of(m, a[0] + b[0])
        if b[1] is None:
            return head, body, tail
        return head, (body or 0) + b[1], b[2]
    body = a[1] + m.run(m.run(m.start, a[2])[0], b[0])[1]
    if b[1] is not None:
        return a[0], body + b[1], b[2]
    tail = a[2] + b[0]
    last = _LAST_MEET.search(tail)
    return a[0], body, tail[last.start() :] if last else tail


def total(m: Machine, a: tuple) -> int:
    """The count from the initial state."""
    return m.run(m.start, a[0])[1] + (a[1] or 0)


def compose(m: Machine, maps: list[tuple]) -> tuple[str, int | None, str]:
    """The map of consecutive maps, as a balanced tree."""
    while len(maps) > 1:
        maps = [then(m, maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else EMPTY


def whole_counts(m: Machine, texts: list[str | None]) -> list[int]:
    """Counts of whole texts. States refer to each other, which the collector of cycles would follow again and
    again while a pass adds to them."""
    gc.disable()
    try:
        return [sum(1 if special else m.run(m.start, piece)[1] for piece, special in _cut(m.model, t)) if t else 0 for t in texts]
    finally:
        gc.enable()


def count(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text.

    Special tokens in a text count as one token. A null text is empty and has none; a null doc_id is
    carried. Texts of more than ``chunk`` bytes are spread over tasks as chunks, whatever their length; the
    result is the same for any ``chunk``. Rows are counted one by one: repeated ones repeat, an empty
    table stays empty, other columns go, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(Bpe(path or tokenizer_path()))

    def machine() -> Machine:
        kept = worker_cache("count", model.value.key)
        if "machine" not in kept:
            kept["machine"] = Machine(model.value)
        kept["machine"].forget()
        return kept["machine"]

    def whole(batches):
        for batch in batches:
            column = batch.column(2)
            for a, b in slices(column, 4 << 20):
                counts = whole_counts(machine(), column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                serial, uid, doc_id, n_bytes = 0, *(batch.column(k)[i].as_py() for k in range(3))
                for piece, special in _cut(model.value, batch.column(3)[i].as_py()):
                    for at in range(0, len(piece), len(piece) if special else chunk):
                        part = [pa.array([x], t) for x, t in ((uid, pa.int64()), (doc_id, pa.int64()), (n_bytes, pa.int64()), (serial, pa.int64()), (special, pa.bool_()), (None if special else piece[at : at + chunk], pa.string()))]
                        yield pa.RecordBatch.from_arrays(part, ["uid", "doc_id", "n_bytes", "serial", "special", "piece"])
                        serial += 1

    def mapped(batches):
        for batch in batches:
            m = machine()
            maps = [SPECIAL if special else map_of(m, piece) for special, piece in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            columns = [pa.array([x[i] for x in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *columns], ["uid", "doc_id", "n_bytes", "serial", "head", "body", "tail"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        m, frame = machine(), frame.sort_values("serial")
        maps = [(h, None if b != b or b is None else int(b), t) for h, b, t in zip(frame["head"], frame["body"].astype(object), frame["tail"], strict=True)]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].astype("Int64"), "n_bytes": frame["n_bytes"].iloc[:1], "n_tokens": [total(m, compose(m, maps))]})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("n_bytes", size)
    schema = "doc_id long, n_bytes long, n_tokens long"
    short = rows.where(F.col("n_bytes") <= chunk).select("doc_id", "n_bytes", "text").mapInArrow(whole, schema)
    long = rows.where(F.col("n_bytes") > chunk).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_bytes", "text")
    chunks = long.mapInArrow(cut, "uid long, doc_id long, n_bytes long, serial long, special boolean, piece string").repartition("uid", "serial")
    maps = chunks.mapInArrow(mapped, "uid long, doc_id long, n_bytes long, serial long, head string, body long, tail string")
    out = short.unionByName(maps.groupBy("uid").applyInPandas(joined, schema))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
