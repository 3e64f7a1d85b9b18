"""BPE encoding by backtracking, decoding by an offset table.

The encoder reads a word once from left to right.  An Aho-Corasick automaton
over the vocabulary gives the longest token at each position; a token is taken
when its pair with the token before it is one that the merges would leave
alone, else the next shorter prefix token is tried, and when none fits the
encoder steps back one token and marks the position as a dead end.  Each
position is marked once, so the time is linear in the word.  Pairs are judged
by undoing merges on both sides of the cut and are remembered.

White space never reaches a token of this kind of vocabulary, so each stretch
between white space is encoded by itself and remembered in a bounded table.

Cases: a null text counts as empty and gives no ids; any Unicode text is
accepted; ids follow the vocabulary file, special tokens in the text included.
Rows are independent of each other: repeated rows and ids, null or tied
doc_ids and any extra columns have no effect.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import documents, lean, memory

#: Stretches, pieces and pairs that are remembered, and the longest string that is.
STRETCHES, PIECES, PAIRS, LONGEST = 100_000, 200_000, 300_000, 64


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Memory(dict):
    """Results of strings seen before.  When full it stays as it is, as frequent strings
    come early, until it has missed too often; then it begins anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.missed = most, 0

    def keep(self, key, value) -> None:
        if len(self) < self.most:
            self[key] = value
            return
        self.missed += 1
        if self.missed > 20 * self.most:
            self.clear()
            self.missed = 0


class Encoder:
    """Exact BPE for vocabularies with byte letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a lower-case vocabulary with word ends")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V1)
        self._space = regex.compile(r"\p{White_Space}+")
        self._odd_space = regex.compile("[\x1c-\x1f]")
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        # A letter at the end of a word is a symbol of its own.
        self._inner = letters
        self._final = [chr(0x10000 + ord(c)) for c in letters]
        symbol = {c: c for c in letters} | {c + suffix: f for c, f in zip(letters, self._final, strict=True)}

        def symbols(token: str) -> str:
            body = token.removesuffix(suffix)
            return body if body == token else body[:-1] + symbol[body[-1] + suffix]

        self.strings = token_strings(path)
        base = {i for token, i in vocab.items() if token in symbol}
        # Merge order stands in for ids: rank 0.. for base symbols, then merges.
        self._id = np.zeros(len(base) + len(model["merges"]), np.int32)
        rank = {}
        for r, i in enumerate(sorted(base)):
            self._id[r] = i
            rank[self.strings[i]] = r
        self._split = [(r, r) for r in range(len(base))]
        self._merged = {}
        for r, (a, b) in enumerate(model["merges"], len(base)):
            if a + b in rank or a + b not in vocab:
                raise ValueError(f"{path}: merge {a!r} {b!r} has no token of its own")
            self._id[r], rank[a + b] = vocab[a + b], r
            self._split.append((rank[a], rank[b]))
            self._merged[rank[a], rank[b]] = r
        self._length, self._automaton = [0] * len(rank), ahocorasick.Automaton()
        names = {}
        for token, r in rank.items():
            s = symbols(token)
            self._length[r], names[s] = len(s), r
            self._automaton.add_word(s, r)
        self._automaton.make_automaton()
        self._shorter = [-1] * len(rank)
        for s, r in names.items():
            self._shorter[r] = next((names[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in names), -1)
        self._fits, self._stretches, self._known = Memory(PAIRS), Memory(STRETCHES), Memory(PIECES)

    def _pair(self, one: int, two: int) -> bool:
        """Whether the merges leave this pair of neighbours as it is."""
        found = self._fits.get((one, two))
        if found is None:
            found = self._judge(one, two)
            self._fits.keep((one, two), found)
        return found

    def _judge(self, one: int, two: int) -> bool:
        limit = len(self._split) + 1
        while True:
            joined = self._merged.get((one, two))
            if joined is not None and joined < limit:
                return False
            undo_left = one > two
            for _ in range(2):
                if undo_left:
                    limit, one = one, self._split[one][1]
                    done = one == limit
                else:
                    limit, two = two + 1, self._split[two][0]
                    done = two + 1 == limit
                if not done:
                    break
                undo_left = not undo_left
            else:
                return True

    def _word(self, word: str) -> list[int]:
        """Ranks of the tokens of one word of symbols."""
        n = len(word)
        longest = [-1] * n
        for end, r in self._automaton.iter(word):
            longest[end - self._length[r] + 1] = r  # later ends are longer
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self._length[token]
                if not dead[end] and (last < 0 or self._pair(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = self._shorter[token]
            else:
                dead[at] = 1
                out.pop()
                at -= self._length[last]
                token = last
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self._known.get(piece)
        if ids is None:
            raw = piece.encode()
            word = "".join([self._inner[b] for b in raw[:-1]]) + self._final[raw[-1]]
            ids = self._id[self._word(word)].tobytes()
            if len(piece) <= LONGEST:
                self._known.keep(piece, ids)
        return ids

    def _stretch(self, text: str) -> bytes:
        out = []
        for part in self._special.split(text) if self._special and "<" in text else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            out += map(self._piece, (part,) if part.isalpha() and part.isascii() else self._pieces.findall(part))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian int32."""
        if not text:
            return b""
        known = self._stretches
        out = []
        for s in self._space.split(text) if self._odd_space.search(text) else text.split():
            ids = known.get(s)
            if ids is None:
                ids = self._stretch(s)
                if len(s) <= LONGEST:
                    known.keep(s, ids)
            out.append(ids)
        return b"".join(out)


class OffsetTable:
    """Strings of all ids in one buffer; joining many is one gather."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in strings])])

    def join(self, ids: np.ndarray) -> bytes:
        """The ids' strings with a space between each two."""
        if not len(ids):
            return b""
        first = self.start[ids]
        size = self.start[ids + 1] - first
        end = np.cumsum(size)
        return self.data[np.arange(end[-1]) + np.repeat(first - end + size, size)][:-1].tobytes()


_KEPT = memory("bpe")


def encoder(path: str) -> Encoder:
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def token_strings(path: str) -> list[str]:
    """The string of each id; empty where there is none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return out


def tables(path: str) -> tuple[OffsetTable, OffsetTable]:
    """Of token strings and of decimal numbers, each with a space at its end."""
    if (path, "tables") not in _KEPT:
        strings = token_strings(path)
        _KEPT[path, "tables"] = OffsetTable([s.encode() + b" " for s in strings]), OffsetTable([b"%d " % i for i in range(len(strings))])
    return _KEPT[path, "tables"]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _slices(column: pa.Array):
    o, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[o[i] : o[i + 1]] for i in range(len(column)))


#: Rows of one output batch hold about this many bytes of text.
STEP = 4 << 20


def _steps(b: pa.RecordBatch, column: int, bytes_per_item: int = 1):
    c = b.column(column)
    values = c.offsets.to_numpy() if pa.types.is_list(c.type) else np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_string(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(values[1:] if len(values) else values, values[i] + STEP // bytes_per_item, side="right")))
        yield b.slice(i, min(j, b.num_rows) - i)
        i = min(j, b.num_rows)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""

    def run(batches):
        e = encoder(path)
        for whole in batches:
            for b in _steps(whole, 1) if whole.num_rows else ():
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([e.encode(t.as_py()) for t in b.column(1)])], ["doc_id", "ids"])

    return documents(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run, "bpe"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the tokens' strings joined by spaces, as the vocabulary names no decoder."""

    def run(batches):
        strings = tables(path)[0]
        for whole in batches:
            for b in _steps(whole, 1, 8) if whole.num_rows else ():
                text = pa.array([strings.join(x).decode() for x in _slices(b.column(1))], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, text], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(lean(run, "bpe"), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame, path: str) -> DataFrame:
    def run(batches):
        numbers = tables(path)[1]
        for b in batches:
            ids = [hashlib.sha256(numbers.join(x)).hexdigest() for x in _slices(b.column(1))] if b.num_rows else []
            size = [len(x) for x in _slices(b.column(1))] if b.num_rows else []
            text = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
