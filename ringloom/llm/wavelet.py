"""Token ids in one compressed file a shard: a wavelet matrix.

Ids of a shard's documents, in ascending doc_id order, each document ended by
END, are split into bit planes. A plane holds one bit of each id, in an order where
the ids with 0 in the plane before come first. A plane is cut into chunks of CHUNK bits,
each compressed by itself, and the file's directory has the ones before each chunk, so
it answers by unpacking one or two chunks a plane: access(i), rank(id, i) (how often id
occurs before i) and select(id, k) (where its k-th occurrence is).

Documents are dealt by ranges of doc_id and sorted, so shards follow one another.
Shards are cut at `shard` tokens, at ends of documents, so memory doesn't depend on the
number of documents in a task; one long document is never cut.

Texts are encoded a word at a time, each distinct word of about 4 MB of texts once, with a bounded memory
of words: the tokenizer's normaliser and splitter treat each stretch between ASCII white space by
itself, so the ids are those of the whole text.

Null texts are empty and get END alone; an empty table gives no files and no rows. Null ids
sort first. Repeated rows each get their tokens, in order of text. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _PLACE, _SPACE, cut, scramble, slices, table

END = 1
MAGIC = b"RLWM2\0"
CHUNK = 1 << 16
BETWEEN = b"<|endoftext|>"
_HEAD = "<6sBQQQ"


#: Words that the normaliser only lower-cases, and their pieces: the pattern of the tokenizer's file
#: for visible Latin-1 characters, letters and numbers written out.
_SIMPLE = re.compile(r"[!-~\xa1-\xff]+").fullmatch
_LETTERS, _NUMBERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS} ]+| ").findall
#: Not an id: between the words that are cut into pieces.
_GAP = b"\xff" * 4
#: Characters from U+0100 on, in UTF-8.
_MARKS = re.compile(rb"[\xc4-\xff]").search
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class WordEncoder:
    """ids of whole texts by words, with the tokenizers library. Up to `limit` words are remembered
    in each of two generations, of which the older goes when the younger is full, and as many
    pieces of words, as new words are mostly of known pieces."""

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self.model.token_to_id(BETWEEN.decode())
        if self.mark is None:
            raise ValueError(f"the tokenizer has no {BETWEEN.decode()}")
        names = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.limit = limit

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _cut(self, between: str, new: list, text: list[str], out: dict) -> None:
        """out[key] = ids of the key's text, many at once; between parts them, and is marked by
        the id that ends each (or stands between each two, where it is a special token)."""
        special = between != " "
        for i in range(0, len(new), 128):
            ids = self.ids(between.join(text[i : i + 128]))
            raw, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark if special else self.ends[ids])).tolist()
            begins, stops = ([0, *(x + 4 for x in at)], [*at, len(raw)]) if special else ([0, *(x + 4 for x in at)][:-1], [x + 4 for x in at])
            if len(stops) != len(new[i : i + 128]):
                raise ValueError("the tokenizer's file doesn't split words as expected")
            out.update(zip(new[i : i + 128], (raw[a:z] for a, z in zip(begins, stops))))

    def _learn(self, new: list[bytes]) -> None:
        known, older, pieces = self.known, self.older, self.pieces
        if len(pieces) > self.limit:
            pieces.clear()
        simple, texts, rest = [], [], []
        for w in new:
            got = older.get(w)
            if got is not None:
                known[w] = got
                continue
            t = w.decode("utf-8", "surrogatepass")
            if "<|" in t:
                known[w] = self.ids(t).tobytes()
            elif _SIMPLE(t):
                simple.append(w)
                texts.append(t)
            else:
                rest.append((w, t))
        if simple:
            flat = _PIECES(" ".join(texts).lower())
            unseen = list(set(flat) - pieces.keys() - {" "})
            self._cut(" ", unseen, unseen, pieces)
            pieces[" "] = _GAP
            raw = b"".join(map(pieces.__getitem__, flat))
            at = (4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == np.frombuffer(_GAP, np.uint32))).tolist()
            known.update(zip(simple, (raw[a:z] for a, z in zip([0, *(x + 4 for x in at)], [*at, len(raw)]))))
        self._cut(BETWEEN.decode(), [w for w, _ in rest], [t for _, t in rest], known)

    def encode(self, texts: list[bytes | None], end: bytes = b"") -> list[bytes]:
        """ids of each of texts (UTF-8), with `end` after them, as 32-bit numbers. A word that
        comes again in them is looked up once."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        texts = [t or b"" for t in texts]
        # what is lower-cased anyway is so at once, but where a letter and a mark after it may be one character
        data = b"\n".join([b"", *(t if _MARKS(t) or b"<|" in t else t.lower() for t in texts), b""])
        begin, stop, code, first = distinct_words(data)
        words = [data[a:z] for a, z in zip(begin[first].tolist(), stop[first].tolist())]
        got = list(map(self.known.get, words))
        if None in got:
            self._learn([w for w, ids in zip(words, got) if ids is None])
            got = list(map(self.known.__getitem__, words))
        flat, n = np.frombuffer(b"".join(got), np.uint32), np.array([len(x) for x in got], np.int64) // 4
        at, k = (np.cumsum(n) - n)[code], n[code]
        upto = np.concatenate([[0], np.cumsum(k)])
        raw = flat[np.repeat(at - upto[:-1], k) + np.arange(upto[-1])].tobytes()
        ends = (4 * upto[np.searchsorted(begin, np.cumsum([1 + len(t) for t in texts]))]).tolist()
        return [raw[a:z] + end for a, z in zip([0, *ends], ends)]


def distinct_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, which begins and ends with white space -> where each word begins and ends, its number among the
    distinct words, and the place of one of each. Words of up to 64 bytes are told apart by 64-bit hashes of their
    bytes and length, which meet only by chance; a longer one is a distinct word each time."""
    bytes_ = np.frombuffer(data, np.uint8)
    space = _SPACE[bytes_]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, stop = edge[::2], edge[1::2]
    size = stop - begin
    padded = np.concatenate([bytes_, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(bytes_), 8), (1, 1))

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at].view("<u8").ravel() & _FIRST[np.minimum(left, 8)]

    h = scramble(part(begin, size) + size.astype(np.uint64) * _PLACE)
    for k in range(8, 64, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = scramble(h[more] * _PLACE + part(begin[more] + k, size[more] - k))
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] > 64)
    code = np.empty(len(h), np.int64)
    code[order] = np.cumsum(new) - 1
    return begin, stop, code, order[new]


_loaded: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """The encoder, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of a shard: head, zeros of each plane, ones before each chunk, where each chunk
    ends, documents, chunks."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zip_ = zstandard.ZstdCompressor(level=1).compress
    zeros, ones, frames = [], [], []
    kind = np.uint16 if bits <= 16 else np.uint32
    cur = ids.astype(kind)
    for level in range(bits - 1, -1, -1):
        bit = ((cur >> kind(level)) & kind(1)).astype(bool)
        before = 0
        for i in range(0, len(bit), CHUNK):
            part = bit[i : i + CHUNK]
            frames.append(zip_(np.packbits(part, bitorder="little").tobytes()))
            ones.append(before)
            before += int(np.count_nonzero(part))
        zeros.append(len(bit) - before)
        cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    docs = zip_(np.diff(numbers, prepend=0).astype("<i8").tobytes() + known.tobytes() + lengths.astype("<u4").tobytes())
    stops = np.cumsum([len(docs), *map(len, frames)])
    directory = (np.array(x, "<u8").tobytes() for x in (zeros, ones, stops))
    return b"".join([struct.pack(_HEAD, MAGIC, bits, len(ids), len(doc_ids), len(frames)), *directory, docs, *frames])


class WaveletMatrix:
    """A shard's file, given as bytes or, by open(), mapped from a path. Only the directory is read at
    first; chunks are unpacked as they are asked for, and the last `most` kept."""

    def __init__(self, data, most: int = 256):
        magic, self.bits, self.n, self.n_docs, frames = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize(_HEAD)
        self._data, self._most, self._held = data, most, {}
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self._per = frames // self.bits  # chunks of a plane
        self._ones = np.frombuffer(data, "<u8", frames, at).astype(np.int64).reshape(self.bits, -1)
        at += 8 * frames
        stops = np.frombuffer(data, "<u8", frames + 1, at).astype(np.int64)
        self._edges = at + 8 * (frames + 1) + np.concatenate([[0], stops])
        docs = self._frame(0)
        d = self.n_docs
        numbers = np.cumsum(np.frombuffer(docs, "<i8", d))
        known = np.frombuffer(docs, np.uint8, d, 8 * d)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known)]
        self.lengths = np.frombuffer(docs, "<u4", d, 9 * d).astype(np.int64)

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[int(self._edges[i]) : int(self._edges[i + 1])])

    def _chunk(self, level: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a chunk, and the ones in the chunk before each 64 of them."""
        key = level * self._per + c
        got = self._held.get(key)
        if got is None:
            raw = np.frombuffer(self._frame(1 + key), np.uint8)
            per = np.bitwise_count(np.concatenate([raw, np.zeros(-len(raw) % 64, np.uint8)])).reshape(-1, 64).sum(1, dtype=np.int64)
            if len(self._held) >= self._most:
                self._held.pop(next(iter(self._held)))
            got = self._held[key] = raw, np.concatenate([[0], np.cumsum(per)])
        return got

    def _bit(self, level: int, i: int) -> int:
        raw, _ = self._chunk(level, i // CHUNK)
        i %= CHUNK
        return int(raw[i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before i."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        raw, before = self._chunk(level, i // CHUNK)
        out, i = int(self._ones[level, i // CHUNK]), i % CHUNK
        block = i >> 9
        out += int(before[block]) + int(np.bitwise_count(raw[64 * block : i >> 3]).sum())
        return out + (int(raw[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            out = out << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return out

    def _down(self, c: int, i: int) -> tuple[int, int]:
        """Where the range of ids before place i with value c begins and ends in the last order."""
        a, b = 0, i
        for level in range(self.bits):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (int(self.zeros[level]) + x, int(self.zeros[level]) + y) if c >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, c: int, i: int) -> int:
        """How often id c occurs before place i."""
        if c < 0 or c >> self.bits or not self.n:
            return 0
        a, b = self._down(c, max(0, min(i, self.n)))
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a plane: its chunk by the directory, then inside."""
        before = self._ones[level] if bit else np.arange(self._per) * CHUNK - self._ones[level]
        c = int(np.searchsorted(before, k, "right")) - 1
        raw, _ = self._chunk(level, c)
        bits = np.unpackbits(raw, count=min(CHUNK, self.n - c * CHUNK), bitorder="little")
        return c * CHUNK + int(np.flatnonzero(bits == bit)[k - int(before[c])])

    def select(self, c: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of id c; -1 if there are fewer."""
        if k < 0 or k >= self.rank(c, self.n):
            return -1
        at = self._down(c, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = c >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) * bit)
        return at

    def _plane(self, level: int) -> np.ndarray:
        raw = b"".join(self._frame(1 + level * self._per + c) for c in range(self._per))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def ids(self) -> np.ndarray:
        """All ids, in order: the planes' orders undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = self._plane(level)
            back = np.empty(self.n, kind)
            z = int(self.zeros[level])
            back[np.flatnonzero(~bit)] = cur[:z]
            back[np.flatnonzero(bit)] = cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = back
        return cur.astype(np.uint32)


def write_shards(docs: DataFrame, path: str, folder: str | None = None, shard: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> written table part, seq, n_docs, n_tokens, file (one row, one file a
    shard); (part, seq) is the order of the shards. path: the tokenizer's file, on every machine.
    folder: where the table is written and stays; without it, a folder of the session in the shared one."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder = loaded(path)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[bytes] = []
        size, end = 0, np.uint32(END).tobytes()

        def file():
            lengths = np.array([len(t) // 4 for t in tokens], np.int64)
            whole = np.frombuffer(b"".join(tokens), np.uint32)
            cols = [[part], [seq], [len(ids)], [len(whole)], [pack(whole, ids, lengths)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_tokens", "file"])

        for b in batches:
            for i, _, many in slices(b.column(1), 4_000_000):
                doc_ids, texts = b.column(0).slice(i, len(many)).to_pylist(), b.column(1).slice(i, len(many)).cast(pa.large_binary()).to_pylist()
                for d, e in zip(doc_ids, encoder.encode(texts, end)):
                    ids.append(d)
                    tokens.append(e)
                    size += len(e) // 4
                    if size >= shard:
                        yield file()
                        ids, tokens, size, seq = [], [], 0, seq + 1
        if ids:
            yield file()

    files = dealt.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, file binary")
    if folder is None:
        return cut(files)
    files.write.parquet(folder)
    return docs.sparkSession.read.schema(files.schema).parquet(folder)


def read_shards(files: DataFrame) -> DataFrame:
    """Shard files -> doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    per = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each task that wrote
    base, at = [], 0
    for r in per:
        base.append((r.part, at))
        at += r.n
    bases = files.sparkSession.createDataFrame(base, "part int, base long")
    before = F.expr("coalesce(sum(n_tokens) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0)")
    # written, so that its size is known: files move only where there are very many of them
    starts = cut(files.select("part", "seq", "n_tokens").withColumn("before", before).join(bases, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("at")))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                a, m = b.column(0)[i].as_py(), WaveletMatrix(b.column(1)[i].as_py())
                ids = m.ids().astype("<u4")
                ends = np.cumsum(m.lengths)
                begins = ends - m.lengths
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(m.doc_ids, pa.int64()), pa.array(a + begins), pa.array(m.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "seq", "file").join(starts, ["part", "seq"]).select("at", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
