"""Removal of long passages that an earlier document holds too: seed and extend.

A window is ``width`` consecutive words.  A window of a document is repeated if
its word sequence also starts in a document with a smaller doc_id; every word
that a repeated window covers goes.  Windows are judged on the input, so the
result doesn't depend on an order of processing.

1. Seeds: within each window the gram (``gram`` words) of least hash is its
   anchor (winnowing).  Equal windows have equal anchors, so a window whose
   anchor occurs in one document only can't be repeated.  Consecutive windows
   with the same anchor form a run; a document has about one run for each
   ``(width - gram) / 2`` words.
2. Runs of equal content are found by one aggregation on (anchor, content) that
   keeps the least doc_id; later documents lose these runs whole.
3. What is left are the first holders of contents that share an anchor with
   other contents: matches that end inside a run.  They are joined on the anchor
   and extended: every pair is compared word by word from the anchor to the left
   and to the right, and where the match is as long as a window, the later
   document loses the windows inside.
4. An anchor of more than ``cell`` contents is too frequent a seed for pairs.
   Its seed is lengthened: a window reaches so many words to the left of the
   anchor and the rest to the right, so the windows are divided by how far they
   reach and each part's seed takes in the words that all its windows have.
   Contents that share the longer seed form smaller groups, and so on, until a
   group is small or its seed is the window.
5. The repeated windows of a document, united, are its maximal repeats.

Aggregations are partial before they shuffle, so a passage of a third of all
documents meets as one row a task; pairs are made of different contents only, in
groups of bounded size; repeated rows are dealt apart where they are many.  Words are compared by hashes of 64 bits each.

Null and empty texts, and texts shorter than a window, lose nothing.  Documents
with a null id come after all others; rows with equal ids never take from each
other.  Repeated rows get a row each.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, groups, likely, parallelism, salted_left_join, spread_join, stash, texts, unused
from .words import U64, encode, mix, span_hashes, window_hashes, word_hashes

NO_ID = 2**63 - 1


@dataclass(frozen=True)
class RepeatParams:
    width: int = 50
    gram: int = 10
    #: Contents of a group that are compared in pairs, and parts that a larger one's windows are divided into.
    cell: int = 64
    parts: int = 4


def _least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every run of ``width`` values, the leftmost of equals, by doubling."""
    at, size = np.arange(len(x)), 1
    pick = lambda a, b: np.where(x[b] < x[a], b, a)
    while 2 * size <= width:
        at = pick(at[: len(at) - size], at[size:])
        size *= 2
    return pick(at[: len(at) - (width - size)], at[width - size :]) if size < width else at


def seed_runs(words: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, anchor hash, content hash.

    Neighbouring runs of equal anchor and content are one, with the windows of all.
    """
    if len(words) < params.width:
        return (np.empty(0, np.int64),) * 4
    grams = window_hashes(words, params.gram)
    anchor = _least_at(grams, params.width - params.gram + 1)
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    counts = np.diff(np.append(starts, len(anchor)))
    content = span_hashes(words, starts, starts + counts - 1 + params.width)
    grams = grams[anchor[starts]]
    # Where words repeat periodically, run after run is the same: one stands for all.
    heads = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (content[1:] != content[:-1]))))
    return starts[heads], np.add.reduceat(counts, heads), grams[heads].view(np.int64), content[heads].view(np.int64)


RUNS = "d bigint, th bigint, code bigint, anchor bigint, content bigint"
#: A run is coded as first window * SPAN + number of windows.
SPAN = 1 << 31


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


KEYED = "d bigint, th bigint, text string"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows of one id and text one."""
    for b in batches:
        first = dict(reversed([*zip(zip(b.column("d").to_pylist(), b.column("th").to_pylist()), range(len(b)))]))
        yield b.take(pa.array(sorted(first.values()), pa.int64()))


def _join(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def find_runs(keyed: DataFrame, params: RepeatParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column("d").to_numpy(), b.column("th").to_numpy()
            found = [seed_runs(word_hashes(encode(t)), params) for t in b.column("text").to_pylist()]
            sizes = [len(f[0]) for f in found]
            codes, anchors, contents = _join([f[0] * SPAN + f[1] for f in found]), _join([f[2] for f in found]), _join([f[3] for f in found])
            yield batch(RUNS, np.repeat(ids, sizes), np.repeat(hashes, sizes), codes, anchors, contents)

    return keyed.mapInArrow(run, RUNS)


#: A run to be extended: its document, first window, windows, times that it follows itself, the words from its first to its last,
#: where its anchor is in them, how far its windows reach to the left of the anchor (least and most), and its seed.
SEEDS = "d bigint, th bigint, start bigint, windows int, times int, words binary, at int, least int, most int, seed bigint"


def find_seeds(flagged: DataFrame, params: RepeatParams) -> DataFrame:
    """The words of flagged runs (rows of d, th, text, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, th, text, codes in zip(b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("codes")):
                words = word_hashes(encode(text))
                grams = window_hashes(words, params.gram)
                anchor = _least_at(grams, params.width - params.gram + 1)
                for code in np.unique(codes.values.to_numpy()).tolist():
                    start, windows = code // SPAN, code % SPAN
                    # Where a run follows itself, all have the windows of the first.
                    one = min(windows, int(np.searchsorted(anchor[start : start + windows], anchor[start], side="right")))
                    at = int(anchor[start]) - start
                    rows.append((d, th, start, one, windows // one, words[start : start + one - 1 + params.width].tobytes(), at, at - one + 1, at, int(grams[anchor[start]].view(np.int64))))
                    if len(rows) >= 5000:
                        yield _seed_batch(rows)
                        rows = []
            if rows:
                yield _seed_batch(rows)

    return flagged.mapInArrow(run, SEEDS)


def _seed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return batch(SEEDS, *zip(*rows))


def extend(words: list[np.ndarray], at: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words (``reach`` at most) every two sequences have in common to the left and to the right of their anchors."""
    n = len(words)
    found = []
    for side in (-1, 1):
        held, known = np.zeros((n, reach), U64), np.zeros((n, reach), bool)
        for k, (w, x) in enumerate(zip(words, at.tolist())):
            part = w[max(0, x - reach) : x][::-1] if side < 0 else w[x + gram : x + gram + reach]
            held[k, : len(part)], known[k, : len(part)] = part, True
        same = (held[:, None] == held[None]) & known[:, None] & known[None]
        found.append(np.where(same.all(axis=2), reach, same.argmin(axis=2)))
    return found[0], found[1]


CODES = "d bigint, th bigint, code bigint"


def _coded(d: int, th: int, start: int, windows: int, times: int, at: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Codes of the windows of a run that reach between low and high words to the left of its anchor."""
    return [(d, th, (start + k * windows + at - high) * SPAN + high - low + 1) for k in range(times)]


def _pairs(params: RepeatParams):
    reach = params.width - params.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for cell in groups(batches, ["seed"]):
            d, at = cell["d"], cell["at"]
            left, right = extend([np.frombuffer(w, U64) for w in cell["words"]], at, params.gram, reach)
            low = np.maximum(np.maximum(cell["least"][:, None], cell["least"][None]), reach - right)
            high = np.minimum(np.minimum(cell["most"][:, None], cell["most"][None]), left)
            for k, other in zip(*np.nonzero((d[None] < d[:, None]) & (low <= high))):
                out += _coded(int(d[k]), int(cell["th"][k]), int(cell["start"][k]), int(cell["windows"][k]), int(cell["times"][k]), int(at[k]), int(low[k, other]), int(high[k, other]))
            if len(out) > 10_000:
                yield batch(CODES, *zip(*set(out)))
                out = []
        if out:
            yield batch(CODES, *zip(*set(out)))

    return run


def _lengthen(params: RepeatParams):
    reach = params.width - params.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, th, start, windows, times, words, at, least, most, seed, low, high in zip(*(b.column(c).to_pylist() for c in (*(f.split()[0] for f in SEEDS.split(", ")), "low", "high"))):
                w = np.frombuffer(words, U64)
                # Parts of the same borders for all runs of the seed.
                step = -(-(high - low + 1) // params.parts)
                for part in range(low, high + 1, step):
                    end = min(part + step - 1, high)
                    lo, hi = max(part, least), min(end, most)
                    if lo <= hi:
                        core = span_hashes(w, np.array([at - part if at >= part else 0]), np.array([min(len(w), at + params.width - end)]))
                        if at < part or at + params.width - end > len(w):
                            continue  # no window of the run has these words
                        rows.append((d, th, start, windows, times, words, at, lo, hi, int(mix(core ^ U64(seed & MASK) ^ U64(part * 64 + end + 1))[0].view(np.int64)), part, end))
            yield batch(f"{SEEDS}, low int, high int", *zip(*rows)) if rows else batch(f"{SEEDS}, low int, high int", *[[]] * 12)

    return run


MASK = (1 << 64) - 1


def extended(seeds: DataFrame, params: RepeatParams) -> DataFrame:
    """Windows of runs that an earlier document's run has too: d, th and code.

    A round compares the groups that are small and lengthens the seeds of the
    others; ``low`` and ``high`` are the borders of a seed's part.
    """
    reach = params.width - params.gram
    state = stash(seeds.withColumn("low", F.lit(0)).withColumn("high", F.lit(reach)))
    found = []
    for _ in range(reach + 1):
        rows = state.count()
        if not rows:
            break
        sizes = state.groupBy("seed").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last")).where("n > 1 and first < last").drop("last")
        held = spread_join(state, sizes, ["seed"], "n", rows)
        small, whole = F.col("n") <= params.cell, F.col("low") == F.col("high")
        cells = held.where(small & ~whole).repartition(parallelism(seeds), "seed").sortWithinPartitions("seed")
        found.append(stash(cells.mapInArrow(_pairs(params), CODES)))
        # Where the seed is the window, no comparison is left.
        done = held.where(whole & (F.col("first") < F.col("d")))
        each = F.explode(F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda k: (F.col("start") + k * F.col("windows") + F.col("at") - F.col("low")) * SPAN + 1)).alias("code")
        found.append(done.select("d", "th", each))
        state = stash(held.where(~small & ~whole).select(*(f.split()[0] for f in SEEDS.split(", ")), "low", "high").mapInArrow(_lengthen(params), f"{SEEDS}, low int, high int"))
    union = found[0] if found else seeds.select("d", "th", F.col("start").alias("code"))
    for more in found[1:]:
        union = union.unionByName(more)
    return union


def repeats(keyed: DataFrame, params: RepeatParams) -> DataFrame:
    """Each document (d, th) that has repeated windows, with their coded runs."""
    runs = stash(find_runs(keyed, params))
    contents = runs.groupBy("anchor", "content").agg(F.min("d").alias("first"), F.count("*").alias("times"))
    shared = contents.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("first").alias("high"))
    shared = shared.where("n > 1 and low < high").select("anchor", F.lit(True).alias("partly"))
    told = stash(contents.join(shared, "anchor", "left").where("times > 1 or partly"))
    # Repeated rows have the same runs, so a set holds no more than one text's.
    judged = stash(
        spread_join(runs, told, ["anchor", "content"], "times", runs.count())
        .where("first < d or partly")
        .groupBy("d", "th")
        .agg(
            F.collect_set(F.when(F.col("first") < F.col("d"), F.col("code"))).alias("whole"),
            F.collect_set(F.when(F.col("first") == F.col("d"), F.col("code"))).alias("codes"),
        )
    )
    partly = judged.where(F.size("codes") > 0).select("d", "th", "codes")
    # Rows that agree in id and text are extended once.
    flagged = likely(keyed, partly).mapInArrow(_once, KEYED).join(partly, ["d", "th"]).dropDuplicates(["d", "th"])
    single = extended(find_seeds(flagged, params), params).groupBy("d", "th").agg(F.collect_list("code").alias("whole"))
    return judged.where(F.size("whole") > 0).select("d", "th", "whole").unionByName(single).groupBy("d", "th").agg(F.flatten(F.collect_list("whole")).alias("codes"))


def covered(n: int, codes: np.ndarray, width: int) -> np.ndarray:
    """Which of n words the coded runs of windows cover."""
    change = np.zeros(n + 1, np.int64)
    at, counts = codes // SPAN, codes % SPAN
    np.add.at(change, at, 1)
    np.add.at(change, at + counts - 1 + width, -1)
    return np.cumsum(change)[:n] > 0


KEPT = "doc_id bigint, th bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), with_text: bool = True) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_removed, kept (the kept words joined by one space; null
    without ``with_text``) and kept_sha256."""
    keyed = _keyed(docs)
    joined = salted_left_join(keyed, stash(repeats(keyed, params)), ["d", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, th, text, codes in zip(b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("codes")):
                data = encode(text)
                words, gone = data.split(), 0
                if codes.is_valid:
                    drop = covered(len(words), codes.values.to_numpy(), params.width)
                    gone = int(drop.sum())
                    words = [w for w, x in zip(words, drop.tolist()) if not x]
                kept = b" ".join(words)
                out.append((None if d == NO_ID else d, th, len(words) + gone, gone, kept.decode("utf-8", "surrogatepass") if with_text else None, sha256(kept).hexdigest()))
            yield batch(KEPT, *zip(*out)) if out else batch(KEPT, *[[]] * 6)

    return joined.mapInArrow(run, KEPT)


def without_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """The documents, columns as they are, with repeated passages cut from their texts and n_chars (if there is such a column) brought up to date.

    A text that loses nothing stays as it is; a document that loses every word goes.
    """
    names, schema = docs.columns, docs.schema
    d, th, held = unused(docs, "d", "th", "codes")
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeats(_keyed(docs), params).select(F.col("d").alias(d), F.col("th").alias(th), F.col("codes").alias(held))
    joined = salted_left_join(keyed, stash(found), [d, th]).select(*names, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, stays, changed = b.column("text").to_pylist(), np.ones(len(b), bool), {}
            for k, codes in enumerate(b.column(held)):
                if codes.is_valid:
                    words = encode(given[k]).split()
                    drop = covered(len(words), codes.values.to_numpy(), params.width)
                    given[k] = b" ".join(w for w, x in zip(words, drop.tolist()) if not x).decode("utf-8", "surrogatepass")
                    changed[k], stays[k] = len(given[k]), not drop.all()
            columns = {n: b.column(n) for n in names}
            columns["text"] = pa.array(given, pa.string())
            if "n_chars" in columns:
                sizes = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([changed.get(k, x) for k, x in enumerate(sizes)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays))

    return joined.mapInArrow(run, schema)
