"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are numbered by falling frequency in the corpus, so common tokens take one
byte.  Of each id the low 1 to 4 bytes are stored; the lengths stand apart, two
bits each, in control bytes; each document begins a new one.  A reader looks up the lengths of four ids at once
in a table of 256 entries and gathers all bytes with numpy.

File format: a folder of Parquet files, which Spark commits as a whole.  A row
is a block of whole documents: ``shard`` and ``block`` (their order), ``start``
(ids of the shard before the block), ``n`` (ids of the block), ``doc_ids`` and ``counts`` (int64, little
endian), ``control`` and ``data``.  Beside it lies the table of ranks.  Blocks
are in ascending doc_id order within a shard and shards among each other.

Cases: a null text is an empty document of one end id; null doc_ids come first
and are given back as null; rows that share a doc_id stand side by side in
order of their ids' bytes.  An empty table gives empty files.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .hashing import mix
from .shared import NULL_ID, batch, blocks, bytes_of, documents, ids_of, lean, memory, scratch, table

#: Pre-tokens of which the ids are kept (some 40 bytes each).
REMEMBERED = 1_500_000
#: Bytes of a pre-token that is its own key, and of longer ones that are kept.
SHORT, HELD = 15, 1 << 26
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of text, and pre-tokens, that are encoded at a time.
STEP, ASKED = 1 << 21, 20_000
#: Ids of a block; a longer document is a block of its own.
BLOCK = 1 << 16


_LETTER, _DIGIT, _OTHER, _SPACE, _WHOLE = range(5)
#: Classes of bytes in texts of ASCII and Latin letters; a text with a byte of the last class is encoded whole.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(0x1C, 0x20), 0x7F, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = _WHOLE


def pre_tokens(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the byte-level pre-tokens of concatenated texts, and which texts cannot be cut so.

    A pre-token is a contraction, a stretch of letters, digits or other
    characters with the space before it, or white space: of a stretch of it
    the last character stands alone unless it is a space that is taken or the text's end.
    """
    n = len(buf)
    kind = _CLASS[buf]
    head = np.zeros(n + 1, bool)  # first byte of a text
    head[0] = True
    head[ends] = True
    pair = np.zeros(n, bool)
    pair[1:] = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))  # the signs for times and divided by
    text = np.searchsorted(ends, np.flatnonzero((kind == _WHOLE) | pair), side="right")
    whole = np.zeros(len(ends), bool)
    whole[text] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    tail = head[1:]  # last byte of a text
    following = np.append(kind[1:], _SPACE)
    last = (kind == _SPACE) & (following != _SPACE) & ~tail
    start |= last
    taken = np.flatnonzero(last & (buf == 32)) + 1
    start[taken] = False
    # Contractions: an apostrophe that is alone and has no space before it.
    mark = np.flatnonzero((buf == 39) & start & ~tail)
    mark = mark[(mark + 1 < n) & (kind[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        one = buf[mark + 1]
        two = buf[np.minimum(mark + 2, n - 1)]
        inside = ~tail[mark + 1] & (mark + 2 < n)
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)), 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + size
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start), whole


class Tokenizer:
    """The tokenizers library, asked once for each distinct pre-token.

    Byte-level pre-tokens are encoded independently of each other, so the ids
    of a text are those of its pre-tokens.  A pre-token of up to 15 bytes is known by
    these bytes and its length in two integers, a longer one by its number in a
    dictionary.  Ids are kept in arrays sorted by a mixture of the two; a batch looks all of
    its own up at once and compares the integers themselves.  Texts with a special
    token, control characters or letters outside the Latin blocks go to the library whole,
    as do those with a pre-token whose mixture another one has.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self._t = tokenizers.Tokenizer.from_file(path)
        self._t.no_truncation()
        self._t.no_padding()
        vocabulary = self._t.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self._bytes = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self._bytes[i] = len(token)  # one letter for each byte
        self._special = [t.content.encode() for t in self._t.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros((3, 0), np.uint64)  # mixture, then the two integers
        self._at, self._n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.int32)
        self._long: dict[bytes, int] = {}
        self._held = 0

    def _key(self, buf: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Three rows: a mixture to sort by, and the two integers that are the pre-token."""
        n = stop - start
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        words = np.ndarray((len(buf) + 9,), "<u8", buffer=padded, strides=(1,))
        one = words[start] & _BYTES[np.minimum(n, 8)]
        two = words[np.minimum(start + 8, len(buf))] & _BYTES[np.clip(n - 8, 0, 7)]
        two |= np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
        for i in np.flatnonzero(n > SHORT).tolist():
            piece = raw[start[i] : stop[i]]
            if piece not in self._long:
                self._long[piece] = len(self._long)
                self._held += len(piece)
            one[i], two[i] = self._long[piece], 0
        return np.stack([mix(one) ^ mix(two + np.uint64(0x9E3779B97F4A7C15)), one, two])

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pre-tokens; where a piece ends follows from its number of bytes."""
        for i in range(0, len(pieces), ASKED):
            part = pieces[i : i + ASKED]
            ids = np.array(self._t.encode_batch_fast([[p.decode() for p in part]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum([len(p) for p in part])) + 1
            n = np.diff(np.concatenate([[0], ends]))
            self._keys = np.concatenate([self._keys, keys[:, i : i + ASKED]], axis=1)
            self._at = np.concatenate([self._at, len(self._ids) + ends - n])
            self._n = np.concatenate([self._n, n])
            self._ids = np.concatenate([self._ids, ids])
        order = np.argsort(self._keys[0], kind="stable")
        self._keys, self._at, self._n = self._keys[:, order], self._at[order], self._n[order]

    def encode(self, buf: np.ndarray, ends: np.ndarray, dtype: str) -> list[bytes]:
        """Ids of each of the concatenated texts, as little-endian integers."""
        if not len(ends):
            return []
        start, whole = pre_tokens(buf, ends) if len(buf) else (np.zeros(0, np.int64), np.zeros(len(ends), bool))
        raw = buf.tobytes()
        begin = np.concatenate([[0], ends[:-1]])
        for s in self._special:
            if s in raw:
                whole |= np.array([s in raw[i:j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)])
        text = np.searchsorted(ends, start, side="right")
        stop = np.append(start[1:], len(buf))
        good = ~whole[text]
        start, stop, text = start[good], stop[good], text[good]
        if self._keys.shape[1] > REMEMBERED or self._held > HELD:
            self._clear()
        keys = self._key(buf, raw, start, stop)
        distinct, first, which = np.unique(keys[0], return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys[0], distinct)
        new = np.ones(len(distinct), bool)
        inside = at < self._keys.shape[1]
        new[inside] = self._keys[0, at[inside]] != distinct[inside]
        if new.any():
            x = first[new]
            self._learn(keys[:, x], [raw[i:j] for i, j in zip(start[x].tolist(), stop[x].tolist(), strict=True)])
            at = np.searchsorted(self._keys[0], distinct)
        other = (self._keys[1:, at][:, which] != keys[1:]).any(axis=0)
        whole[text[other]] = True
        n, place = self._n[at][which], self._at[at][which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.arange(total[-1]) + np.repeat(place - total[:-1], n)].astype(dtype)
        cut = total[np.searchsorted(text, np.arange(len(ends)), side="right")] * ids.itemsize
        out = _cut(ids.tobytes(), cut)
        for i in np.flatnonzero(whole).tolist():
            found = self._t.encode(raw[begin[i] : ends[i]].decode(), add_special_tokens=False)
            out[i] = np.array(found.ids, dtype).tobytes()
        return out


_TOKENIZERS = memory("tokens")


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


#: Lengths of the four ids that a control byte stands for.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """Control bytes and data bytes of 32-bit numbers, and where each document's end.

    Each document begins a control byte of its own; unused places in its last
    one are 0 and have no data.
    """
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    width = -(-counts // 4)
    codes = np.zeros(int(width.sum()) * 4, np.uint8)
    codes[_places(counts)] = size - 1
    c = codes.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
    return control.tobytes(), np.cumsum(width), data.tobytes(), ends


def _places(counts: np.ndarray) -> np.ndarray:
    """Places of the documents' numbers when each takes a multiple of four."""
    width = -(-counts // 4) * 4
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(width) - width - np.cumsum(counts) + counts, counts)


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_places(counts)]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _cut(raw: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
BLOCKS = "shard int, block long, start long, n long, doc_ids binary, counts binary, control binary, data binary"
_COUNTS = pa.schema([("id", pa.int32()), ("n", pa.int64())])


def count_ids(encoded: DataFrame, size: int, dtype: str) -> DataFrame:
    """id, n over the whole corpus; one partial row for each id and task."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(bytes_of(b.column(0))[0].view(dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield batch(_COUNTS, seen.astype(np.int32), total[seen])

    return encoded.select("ids").mapInArrow(lean(run, "tokens"), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, block: int = BLOCK) -> None:
    """Encode every whole text, end it with ``end_id`` and write the files to ``folder``."""
    spark = docs.sparkSession
    size = max(tokenizer(path).size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<i4"
    end = np.array([end_id], dtype).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        np.seterr(over="ignore")
        t = tokenizer(path)
        for b in batches:
            buf, ends = bytes_of(b.column(1))
            for i, j, lo, hi in blocks(ends, STEP):
                yield batch(schema, b.column(0).slice(i, j - i), [x + end for x in t.encode(buf[lo:hi], ends[i:j] - lo, dtype)])

    encoded = table(documents(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(encode, "tokens"), "doc_id long, ids binary"), "ids")
    # At most one row for each entry of the vocabulary, whatever the corpus.
    counts = count_ids(encoded, size, dtype).toPandas().sort_values(["n", "id"], ascending=[False, True])
    rank = np.zeros(size, np.uint32)
    by_rank = counts["id"].to_numpy(np.int32)
    rank[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def fill(batches):
        from pyspark import TaskContext

        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def close():
            ids, counts, control, data = zip(*held, strict=True)
            return batch(_BLOCKS, [shard], [number], [before], [sum(counts)], [np.array(ids, "<i8").tobytes()], [np.array(counts, "<i8").tobytes()], [b"".join(control)], [b"".join(data)])

        for b in batches:
            raw, ends = bytes_of(b.column(1))
            ids = raw.view(dtype)
            counts = np.diff(np.concatenate([[0], ends])) // ids.itemsize
            control, c, data, d = pack(shared.value[ids], counts)
            for doc, n, x, y in zip(ids_of(b.column(0)).tolist(), counts.tolist(), _cut(control, c), _cut(data, d), strict=True):
                if held and size + n > block:
                    yield close()
                    number, before, held, size = number + 1, before + size, [], 0
                held.append((doc, n, x, y))
                size += n
        if held:
            yield close()

    n = spark.conf.get("spark.sql.shuffle.partitions")
    # Ranges are sampled from the written ids, so no Python runs for the sample.
    encoded.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(lean(fill, "tokens"), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


_DOCS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian uint32) from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ranks = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    ids = spark.sparkContext.broadcast(ranks["id"].to_numpy("<u4"))

    def run(batches):
        for b in batches:
            for shard, _, start, _, docs, counts, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, counts = np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i8")
                values = ids.value[unpack(control, data, counts)]
                end = np.cumsum(counts)
                yield batch(_DOCS, np.full(len(docs), shard, np.int32), docs, start + end - counts, _cut(values.tobytes(), end * 4))

    # One number for each shard, that is for each partition of the writer.
    rows = blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    offset, offsets = 0, []
    for r in rows:
        offsets.append((r["shard"], offset))
        offset += r["n"]
    before = spark.createDataFrame(offsets, "shard int, offset long")
    out = blocks.mapInArrow(lean(run, "tokens"), "shard int, doc_id long, start long, ids binary")
    return out.join(F.broadcast(before), "shard").select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"), "ids")


def token_output(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Write the files, read them back; see read_tokens."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder, end_id, block)
    return read_tokens(docs.sparkSession, folder)


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
