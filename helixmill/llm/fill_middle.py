"""Fill-in-the-middle rearrangement of texts, and its undoing.

A text is a row of units: runs of ASCII letters, and every other code point by
itself.  Two cuts between units, drawn from a hash of the document's id, part it
into prefix, middle and suffix, which are written in another order behind marks.

Cuts are counted in units, texts are cut in code points.  Texts are divided into
blocks of a fixed number of code points; a Fenwick tree over the blocks of a
batch holds how many units start in a block and how many code points it has.
One descent by halving steps finds the block in which a cut's unit starts and
the code points before it; the unit is then looked for in that block alone.

A null text is empty, an empty text stays plain, a null id hashes as no digits.
Each row is treated for itself: repeated rows give repeated results, an empty
table gives none, other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: What prefix, suffix and middle are marked with.  No mark overlaps another or itself, so a text
#: without them has none across a seam either.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = "n bigint, prefix_chars bigint, middle_chars bigint"
#: Code points that are worked on at once (a longer text is taken by itself).
BATCH = 1 << 20


@dataclass(frozen=True)
class MiddleParams:
    #: What the hash of an id begins with.
    seed: int = 1
    #: Of a hundred texts, how many are rearranged, and of a hundred of those, how many begin with the suffix.
    share: int = 90
    suffix_first: int = 20
    #: Code points in a block.
    block: int = 256


class Fenwick:
    """Sums of whole numbers over blocks: sums of a leading part, and the blocks that fit below a target."""

    def __init__(self, *values: np.ndarray):
        self.n = len(values[0])
        self.trees = []
        for v in values:
            tree, step = np.concatenate(([0], v)), 1
            while 2 * step <= self.n:
                at = np.arange(2 * step, self.n + 1, 2 * step)
                tree[at] += tree[at - step]
                step *= 2
            self.trees.append(tree)

    def before(self, at: np.ndarray) -> list[np.ndarray]:
        """The sums of the blocks before some blocks."""
        sums, at = [np.zeros(len(at), np.int64) for _ in self.trees], at.copy()
        while at.any():
            for s, tree in zip(sums, self.trees):
                s += tree[at]
            at &= at - 1
        return sums

    def descend(self, targets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many leading blocks have a first sum of at most each target, and their sums."""
        at, sums = np.zeros(len(targets), np.int64), [np.zeros(len(targets), np.int64) for _ in self.trees]
        step = 1 << self.n.bit_length()
        while step := step // 2:
            to = np.minimum(at + step, self.n)
            go = (at + step <= self.n) & (sums[0] + self.trees[0][to] <= targets)
            for s, tree in zip(sums, self.trees):
                s += np.where(go, tree[to], 0)
            at = np.where(go, to, at)
        return at, sums


def unit_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each code point of texts that begin at some of them."""
    low = codes | 32
    letter = (low >= 97) & (low <= 122)
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[begins[begins < len(codes)]] = True
    return starts


def cut_texts(found: list[str], first: np.ndarray, second: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points in its prefix and middle.

    The prefix has min(first % (n + 1), second % (n + 1)) of n units, prefix and
    middle together the larger number.
    """
    sizes = np.array([len(t) for t in found], np.int64)
    codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum(sizes) - sizes
    blocks = -(-sizes // block)
    first_block = np.cumsum(blocks) - blocks
    # Blocks don't cross texts.
    inside = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    block_at = np.repeat(begins, blocks) + inside * block
    if not len(block_at):
        none = np.zeros(len(sizes), np.int64)
        return none, none, none
    starts = unit_starts(codes, begins)
    tree = Fenwick(np.add.reduceat(starts, block_at, dtype=np.int64), np.diff(np.append(block_at, len(codes))))
    units_before = tree.before(first_block)[0]
    n = tree.before(first_block + blocks)[0] - units_before
    one, two = first % (n + 1), second % (n + 1)

    def boundary(units: np.ndarray) -> np.ndarray:
        """Code points of each text before the unit of a number; all of them if that is past its last unit."""
        found, inner = sizes.copy(), np.flatnonzero(units < n)
        at, (before, chars) = tree.descend(units_before[inner] + units[inner])
        spots = chars[:, None] + np.arange(block)
        here = starts[np.minimum(spots, len(codes) - 1)] & (spots < len(codes))
        rank = (units_before[inner] + units[inner] - before)[:, None]
        found[inner] = chars + np.argmax(np.cumsum(here, axis=1) > rank, axis=1) - begins[inner]
        return found

    prefix = boundary(np.minimum(one, two))
    return n, prefix, boundary(np.maximum(one, two)) - prefix


def _parts(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BATCH:
            yield slice(start, i)
            start, held = i, 0
        held += size
    yield slice(start, len(sizes))


def cuts(text: Column, first: Column, second: Column, params: MiddleParams) -> Column:
    """Struct of n, prefix_chars and middle_chars of a text for two numbers."""

    @F.pandas_udf(CUTS)
    def run(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        found, a, b = text.tolist(), first.to_numpy(np.int64), second.to_numpy(np.int64)
        rows = [cut_texts(found[s], a[s], b[s], params.block) for s in _parts([len(t) for t in found])]
        return pd.DataFrame(dict(zip(("n", "prefix_chars", "middle_chars"), map(np.concatenate, zip(*rows)))))

    return run(text, first, second)


def rearrange(docs: DataFrame, params: MiddleParams = MiddleParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars, middle_chars (null if plain) and output.

    psm writes prefix, suffix, middle; spm suffix, prefix, middle.  Texts that
    hold a mark stay plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    held = texts(docs, id_col, text_col)
    found = held.select("doc_id", "text", cuts(F.col("text"), h[0], h[1], params).alias("cuts"), h[2].alias("h3"), h[3].alias("h4"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= params.share)
    formed = found.select(
        "doc_id", "text", "cuts", F.when(plain, "plain").when(F.col("h4") % 100 < params.suffix_first, "spm").otherwise("psm").alias("form")
    )
    p, m = F.col("cuts.prefix_chars").cast("int"), F.col("cuts.middle_chars").cast("int")
    piece = lambda start, size: F.substring(F.col("text"), start + 1, size)
    prefix, middle, suffix = piece(F.lit(0), p), piece(p, m), piece(p + m, F.lit(2**31 - 1) - p - m)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    told = lambda c: F.when(F.col("form") != "plain", F.col(f"cuts.{c}")).alias(c)
    return formed.select("doc_id", "text", F.col("cuts.n").alias("n"), "form", told("prefix_chars"), told("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def digest_rearranged(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of each output and of the text restored from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = rearrange(docs, params)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
