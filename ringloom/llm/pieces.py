"""SentencePiece encoding and decoding by a streaming Viterbi over backpointers.

The model is a BPE one. A row of pieces is what BPE gives for a text just if each two
neighbours are what it gives for them alone, so every prefix of a text has exactly
one last piece: the piece that ends there and may follow the last piece of the prefix
before it. That is a Viterbi search in which a path costs nothing or is impossible.
Backpointers are kept for a window bounded by the longest piece: as soon as the
paths of the last positions all go through one boundary, the ids before it are
committed and the window moves on. The ids are those of the library, which a
test holds against it, and a piece pair's test is a short merge, remembered.

Characters without a piece become their UTF-8 bytes' pieces. No other piece crosses
them, nor the place before a word's space mark, so each stretch in between is
searched once and remembered in tables of a bounded number of stretches, of one long text as of many.

Null texts have no ids, as empty ones. Rows stay one to one, ids null or not, repeated or not;
an empty table gives an empty one. Kept columns must not be called as the result's own. A text of any
length is one row; memory grows with its ids alone. Decoding gives the text back,
except that U+2581, the space mark itself, comes back as a space, and lone surrogates as U+FFFD.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows, table, thrifty

MARK = "▁"


class Memory(dict):
    """Results by stretch, made where missing: those of the last `limit` stretches new to it, and of as many before
    them, which come back when asked for. So what is frequent stays, and 2 * limit are held at most. make: gives
    the result and whether to hold it."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out, hold = self.make(key)
            if not hold:
                return out
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = out
        return out


class Pieces:
    """A BPE model's pieces, with encoding and decoding."""

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {i: model.get_score(i) for i in plain}
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        # a piece that BPE doesn't give for its own text is never a result
        self.whole = {p: i for p, i in self.id.items() if self.merge(p) == [p]}
        self.longest = max(map(len, self.whole))
        # lengths of the pieces that end with these three characters, or with fewer
        ending: dict[str, set[int]] = {}
        for p in self.whole:
            ending.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {e: tuple(sorted({1, 2} | n, reverse=True)) for e, n in ending.items()}
        self.letters = frozenset(p for p in self.id if len(p) == 1)
        self.joined = frozenset(p[i : i + 2] for p in self.id for i in range(len(p) - 1))
        self.limit = limit
        self.pairs: dict[int, bool] = {}
        self.known = Memory(lambda w: self.made(MARK + w), limit)  # words after a space
        self.bare = Memory(self.made, limit)
        self.newline = array("i", [self.byte[10]]).tobytes() if 10 in self.byte and "\n" not in self.id else None
        # what each id stands for; a byte above ASCII needs its neighbours
        self.plain = ["" if self.value.get(i, 0) > 127 else chr(self.value[i]) if i in self.value else self.text.get(i, "").replace(MARK, " ") for i in range(size)]
        self.high = np.array([self.value.get(i, 0) > 127 for i in range(size)])

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the neighbours that make the best piece are merged, first ones first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.id.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves piece b after piece a as they are."""
        known = self.pairs.get(a << 20 | b)
        if known is None:
            if len(self.pairs) >= 3 * self.limit // 2:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[a << 20 | b] = self.merge(x + y) == [x, y]
        return known

    def stream(self, text: str):
        """Ids of a stretch of characters that all have pieces, committed as soon as they are sure:
        a window of backpointers goes along, and when it is four times as long as the longest piece, the
        ids before the boundary on which all paths of its last positions converge leave it."""
        get, known, possible, most = self.whole.get, self.pairs.get, self.lengths.get, self.longest
        last: list[int] = []  # the last piece of each prefix in the window
        lengths: list[int] = []
        base = 0  # where the window begins: all paths go through it
        root: int | None = None  # the piece that ends there
        for end in range(1, len(text) + 1):
            for length in possible(text[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - length
                if start < base:
                    continue
                piece = get(text[start:end])
                if piece is None:
                    continue
                before = last[start - base - 1] if start > base else root
                if before is not None:
                    ok = known(before << 20 | piece)
                    if ok is None:
                        ok = self.follows(before, piece)
                    if not ok:
                        continue
                last.append(piece)
                lengths.append(length)
                break
            else:
                raise ValueError(f"no piece ends at {end} of {text!r}")
            if end - base >= 4 * most:
                # the boundaries that all paths of the last `most` prefixes share
                ends = set(range(end - most + 1, end + 1))
                while len(ends) > 1:
                    top = max(ends)
                    ends.discard(top)
                    ends.add(max(base, top - lengths[top - base - 1]))
                shared = ends.pop()
                if shared > base:
                    ids, at = [], shared
                    while at > base:
                        ids.append(last[at - base - 1])
                        at -= lengths[at - base - 1]
                    yield from reversed(ids)
                    root = ids[0]
                    del last[: shared - base], lengths[: shared - base]
                    base = shared
        ids, at = [], len(text)
        while at > base:
            ids.append(last[at - base - 1])
            at -= lengths[at - base - 1]
        yield from reversed(ids)

    def made(self, text: str) -> tuple[bytes, bool]:
        """Ids of a stretch without a space mark inside, as 32-bit integers, and whether to remember it: not if it is
        long. Nothing is merged across two neighbours that no piece holds, as a word and its full stop: what lies between
        such places is remembered apart, and the whole only if its head was known."""
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if cuts:
            head, bare = text[: cuts[0]], self.bare
            memory, head = (self.known, head[1:]) if head[0] == MARK else (bare, head)
            hold = head in memory and len(text) <= 100
            cuts.append(len(text))
            return memory[head] + b"".join([bare[text[a:b]] for a, b in zip(cuts, cuts[1:])]), hold
        return self.word(text), len(text) <= 100

    def word(self, text: str) -> bytes:
        """Ids of a stretch without a space mark inside, as 32-bit integers."""
        if self.letters.issuperset(text):
            return array("i", self.stream(text)).tobytes()
        out: list[int] = []
        begin = 0
        for i, c in enumerate(text):
            if c not in self.id:
                if i > begin:
                    out += self.stream(text[begin:i])
                raw = c.encode("utf-8", "replace" if "\ud800" <= c <= "\udfff" else "strict")
                out += [self.byte.get(b, self.unknown) for b in raw] if self.byte else [self.unknown]
                begin = i + 1
        if begin < len(text):
            out += self.stream(text[begin:])
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if MARK in text or "  " in text or text[0] == " " or self.newline is None:
            text = MARK + text.replace(" ", MARK)
            return np.frombuffer(b"".join([self.bare[s] for s in re.findall(f"{MARK}+[^{MARK}]*", text)]), np.int32)
        # the common case: words with single spaces, in lines
        known = self.known.__getitem__
        out: list[bytes] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if i:
                out += (self.newline, self.bare[words[0]])
                del words[0]
            out.extend(map(known, words))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        if not self.high[ids].any() if len(ids) else True:
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if text.startswith(" ") else text
        parts, raw = [], bytearray()
        for i in ids:
            b = self.value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.text.get(i, ""))
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, others: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, ids (array of int), n_ids, round_trip (whether decoding gives the text back,
    null for null texts); others: further columns to keep, instead of none. path: the
    model's file, on every machine."""
    others = others or []
    if {"doc_id", "ids", "n_ids", "round_trip"} & set(others):
        raise ValueError("a kept column has the name of a result's column")

    @thrifty
    def run(batches):
        pieces = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = [pieces.encode(t) for t in texts]
                same = [None if t is None else pieces.decode(i.tolist()) == t for t, i in zip(texts, ids)]
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
                keep = [part.column(2 + k) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([part.column(0), *keep, lists, pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], ["doc_id", *others, "ids", "n_ids", "round_trip"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[2:])
    return cols.mapInArrow(run, f"doc_id long{kinds}, ids array<int>, n_ids long, round_trip boolean")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """ids(doc_id, ids) -> doc_id, text. Null ids give a null text."""

    def run(batches):
        pieces = loaded(path)
        for docs, lists in rows(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([None if i is None else pieces.decode(i) for i in lists], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_path())
