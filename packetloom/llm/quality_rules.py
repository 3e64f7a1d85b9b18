"""Quality rules with risk-controlled thresholds.

Fixed base rules come first.  Further rules reject a document whose measure (such
as symbols per word) exceeds a cutoff; the cutoffs are learned per stratum (the
language) from labelled holdout documents.  A cutoff is admitted only if an
exact binomial test shows that it rejects fewer than ``risk`` / rules of the
clean documents of the stratum: P(X <= rejected | n, risk / rules) must be at
most ``error`` / (strata x rules).  A trial is a distinct text, as copies are not independent.  The cutoffs of a rule are tested in a fixed
order, the least strict first, and the first that fails ends the sequence, which
needs no further correction; strata and rules share the error by Bonferroni.
So with probability 1 - error no stratum loses more than ``risk`` of its clean
documents, whatever the number of cutoffs tried.  Each rule takes the strictest
admitted cutoff; a stratum with too few labels to prove one keeps all that pass
the base rules.

Cases: a null or empty text has no words and fails the base rules; a null lang
is a stratum; rows are independent, repeated rows and null ids pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import FIRST, equal_slices, word_bounds
from .shared import blocks, bytes_of, lean, ship, table

LEAST_WORDS, REPEAT_PERCENT = 50, 50
RISK, ERROR = 0.02, 0.05
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Measure and the cutoffs to try, least strict first.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3]),
    "capitals": ("n_capitals / greatest(n_words, 1)", [4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6]),
    "exclamations": ("n_exclamations / greatest(n_words, 1)", [0.9, 0.7, 0.5, 0.3, 0.2, 0.1]),
}
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations")


def same_as(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each slice, equal where the bytes are; ``key`` sorts them and bytes decide."""
    if not len(key):
        return np.zeros(0, np.int64)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    head = first[which]
    size = stop - start
    equal = (size == size[head]) & equal_slices(buf, start, start[head], np.minimum(size, size[head]))
    for i in np.flatnonzero(~equal).tolist():  # another text with the same key
        x = buf[start[i] : stop[i]]
        head[i] = next(j for j in np.flatnonzero(key == key[i]).tolist() if j == i or (size[j] == size[i] and np.array_equal(buf[start[j] : stop[j]], x)))
    return head


def _repeats(text: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences in order: whether one occurs again in its text, whether it occurred before."""
    order = np.lexsort([np.arange(len(text)), *key, text])
    same = np.zeros(len(order), bool)
    same[1:] = text[order[1:]] == text[order[:-1]]
    for k in key:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    any_ = same.copy()
    any_[:-1] |= same[1:]
    a, b = np.zeros(len(order), bool), np.zeros(len(order), bool)
    a[order], b[order] = any_, same
    return a, b


def measure(buf: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(ends)
    start, stop, text = word_bounds(buf, ends)
    per = lambda where: np.bincount(where, minlength=rows)
    size = np.diff(np.concatenate([[0], ends]))
    of = np.repeat(np.arange(rows), size)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    n = per(text)
    word = same_as(buf, start, stop, FIRST.slices(FIRST.prefix(buf), start, stop))
    at = np.arange(len(word))
    window = at + 3 <= np.cumsum(n)[text]
    w = at[window]
    again = _repeats(text[window], word[w], word[np.minimum(w + 1, len(word) - 1)], word[np.minimum(w + 2, len(word) - 1)])[0]
    edge = np.zeros(len(word) + 3, np.int64)
    hit = w[again]
    for j in range(3):
        edge[hit + j] = 1
    # Lines: between line feeds and the ends of texts.
    feeds = np.flatnonzero(buf == 10)
    line_end = np.sort(np.concatenate([feeds, ends]))
    line_text = np.sort(np.concatenate([of[feeds], np.arange(rows)]))
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    first = np.ones(len(line_end), bool)
    first[1:] = line_text[1:] != line_text[:-1]
    line_start[first] = (ends - size)[line_text[first]]
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    ls, le, lt = line_start[worded], line_end[worded], line_text[worded]
    before = _repeats(lt, same_as(buf, ls, le, FIRST.slices(FIRST.prefix(buf), ls, le)))[1]
    counts = [n, np.bincount(text, weights=points[stop] - points[start], minlength=rows), per(of[_SYMBOL[buf]]), per(lt[before]), np.bincount(text, weights=edge[: len(word)], minlength=rows), per(lt), per(of[(buf >= 65) & (buf <= 90)]), per(of[buf == 33])]
    return {k: v.astype(np.int64) for k, v in zip(NAMES, counts, strict=True)}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, same (equal for equal texts) and the counts of NAMES for each whole text."""
    ship(docs.sparkSession)

    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            buf, ends = bytes_of(b.column(2))
            for i, j, lo, hi in blocks(ends):
                m = measure(buf[lo:hi], ends[i:j] - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(m[k]) for k in NAMES), b.column(3).slice(i, j - i)], names=["doc_id", "lang", *NAMES, "same"])

    columns = (F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("same"))
    return docs.select(*columns).mapInArrow(lean(run), "doc_id long, lang string, " + ", ".join(f"{k} long" for k in (*NAMES, "same")))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=np.float64)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + np.log(p) - np.log1p(-p))])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def choose(found: list[tuple[str, str, int, int]], risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """The strictest admitted cutoff of each (stratum, rule).

    ``found``: stratum, rule, number of the rule's cutoffs exceeded, clean documents.
    """
    strata = {s for s, *_ in found}
    tests = max(1, len(strata) * len(RULES))
    out = {}
    for s in strata:
        for rule, (_, cutoffs) in RULES.items():
            exceeded = [0] * (len(cutoffs) + 1)
            for stratum, name, level, n in found:
                if (stratum, name) == (s, rule):
                    exceeded[level] += n
            total = sum(exceeded)
            for i, cutoff in enumerate(cutoffs):
                rejected = sum(exceeded[len(cutoffs) - i :])
                if rejected >= total * risk / len(RULES) or at_most(rejected, total, risk / len(RULES)) > error / tests:
                    break
                out[s, rule] = cutoff
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the counts of NAMES, base_failed, kept."""
    rows = table(measures(docs), "measures").withColumn("stratum", F.coalesce("lang", F.lit("")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    clean = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    level = [F.struct(F.lit(name).alias("rule"), sum((F.expr(f"{e} > {c}").cast("int") for c in cutoffs), F.lit(0)).alias("level")) for name, (e, cutoffs) in RULES.items()]
    # Copies are no independent trials: each distinct text counts once.  One row for each stratum, rule and cutoff.
    trials = rows.where(~F.col("base_failed")).join(clean, "doc_id").dropDuplicates(["stratum", "same"])
    found = trials.select("stratum", F.explode(F.array(*level)).alias("x")).groupBy("stratum", "x.rule", "x.level").count().collect()
    cut = choose([tuple(r) for r in found], risk, error)
    bad = F.lit(False)
    for name, (e, _) in RULES.items():
        mine = {s: c for (s, r), c in cut.items() if r == name}
        if mine:
            limit = F.create_map(*(F.lit(x) for pair in sorted(mine.items()) for x in pair))
            bad = bad | F.coalesce(F.expr(e) > F.try_element_at(limit, F.col("stratum")), F.lit(False))
    return rows.select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))
