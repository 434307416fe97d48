"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
from contextlib import suppress
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the one that the session names.

    Only a session that runs in one process may do without; a cluster that names
    no shared folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixmill-checkpoints-"))


def cut(frame: DataFrame) -> DataFrame:
    """Compute a frame once and read it from the shared folder from then on."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that other columns can't clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def parallelism(frame: DataFrame) -> int:
    """Partitions that the session deals shuffles into."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that a frame doesn't have, whatever its own are."""
    taken, found = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Rows from which a key counts as hot, at least.
HOT = 1000


def spread_join(frame: DataFrame, told: DataFrame, key: list[str], count: str, rows: int) -> DataFrame:
    """Join a frame of ``rows`` rows with a table that has one row for each key and says how many rows of the frame have it.

    Keys of more than a thousandth of the rows (1000 at least, so there are 1000
    such keys at most) come by a broadcast and their rows stay where they are;
    the other keys meet by a shuffle that no hot key can unbalance.
    """
    limit = max(HOT, rows // 1000)
    if rows <= limit:
        return frame.join(told, key)
    hot, cold = F.broadcast(told.where(F.col(count) > limit)), told.where(F.col(count) <= limit)
    return frame.join(hot, key).unionByName(frame.join(hot.select(*key), key, "left_anti").join(cold, key))


def salted_left_join(frame: DataFrame, told: DataFrame, key: list[str]) -> DataFrame:
    """Left join with a table that has one row for each key, by a shuffle in which rows of a frequent key are dealt to all partitions.

    Frequent keys are those of more than a thousandth of the rows (and ``HOT``),
    so there are 1000 at most; told's rows for them are repeated for each partition.
    """
    rows, n = frame.count(), parallelism(frame)
    hot = frame.groupBy(*key).agg(F.count("*").alias("_times")).where(F.col("_times") > max(HOT, rows // 1000)).select(*key)
    flag, salt = unused(frame.join(told.limit(0), key, "left"), "flag", "salt")
    hot = F.broadcast(cut(hot).withColumn(flag, F.lit(True)))
    own = F.when(F.col(flag), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).otherwise(0)
    every = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    dealt = frame.join(hot, key, "left").withColumn(salt, own).drop(flag)
    return dealt.join(told.join(hot, key, "left").withColumn(salt, F.explode(every)).drop(flag), [*key, salt], "left").drop(salt)


def constant(values: list, kind: str) -> Column:
    """A nested list of whole numbers as one literal of a Spark type such as ``array<bigint>``."""
    return F.from_json(F.lit(str(values).replace("'", '"').replace("None", "null")), kind)


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
}


def batch(schema: str, *columns) -> pa.RecordBatch:
    """A batch of a flat Spark schema (``name type, ...``) from lists, arrays or numpy arrays."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def stash(frame: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet: for wide or long intermediate tables.

    The files go when the driver ends.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stash-{uuid4().hex}"
    frame.write.parquet(path)
    jvm = spark.sparkContext._jvm

    def clear() -> None:
        with suppress(Exception):  # the session may be gone by then
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    atexit.register(clear)
    return spark.read.parquet(path)


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys in sorted batches, as dicts of numpy arrays; runs may cross batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
        if held is not None:
            cols = {name: np.concatenate((held[name], c)) for name, c in cols.items()}
        changed = np.zeros(len(cols[keys[0]]) - 1, bool)
        for key in keys:
            changed |= cols[key][1:] != cols[key][:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1)]
        for s, e in zip(cuts, cuts[1:]):
            yield {name: c[s:e] for name, c in cols.items()}
        held = {name: c[cuts[-1] :] for name, c in cols.items()}
    if held is not None:
        yield held


#: Rows of the largest membership table that is broadcast; each holds 64 bits.
MAX_WORDS = 1 << 21


def likely(frame: DataFrame, keys: DataFrame, column: str = "th") -> DataFrame:
    """The rows of a frame whose key may be among ``keys``, without a shuffle of the frame.

    Keys set bits of a table that is broadcast: one bit for each of many hash
    values, eight and more times as many as keys, up to a fixed size.  Rows of
    other keys may get through (all of them, if keys are too many for the
    table), so a join has to follow; none that belongs is lost.
    """
    n = keys.count()
    words = 1 << 10
    while words < MAX_WORDS and words * 64 < 16 * n:
        words *= 2
    spread = lambda c: F.xxhash64(c, F.lit(11))
    word = lambda c: F.pmod(spread(c), F.lit(words))
    bit = lambda c: F.shiftrightunsigned(spread(c), 58).cast("int")
    table = keys.groupBy(word(F.col(column)).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col(column)))).alias("_bits"))
    name, bits = unused(frame, "word", "bits")
    table = table.select(F.col("_word").alias(name), F.col("_bits").alias(bits))
    held = frame.withColumn(name, word(F.col(column))).join(F.broadcast(table), name)
    return held.where(F.getbit(bits, bit(F.col(column))) == 1).drop(name, bits)
