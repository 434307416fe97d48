"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model's protobuf is parsed on the driver and rebuilt as a Tokenizer: the
normaliser (character map, white-space rules, marker U+2581 for spaces), the
metaspace dummy prefix, unigram scores or the merges that BPE scores imply, and
byte fallback.  The model file is read by the driver alone and shipped as bytes
(its size is checked), so executors need no path to it.  Models with
user-defined pieces, which SentencePiece cuts out before all else, are refused.

If no piece holds a marker after another character, no token crosses from such
a character to a marker, and a text can be cut there exactly.  Then each
distinct chunk of a batch is encoded once, all of them in one multithreaded
call; otherwise whole texts are.  With ``verify`` every whole text's ids are
compared with the SentencePiece library's own encoding of it.

Null and empty texts encode to no tokens and decode to the empty text.  Repeated
rows are encoded alike; very long texts are encoded whole.  Other columns pass
through unchanged.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch, texts

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Largest model that is broadcast.
MAX_MODEL_BYTES = 64 << 20
#: Bytes of distinct chunks kept by a worker, and the longest chunk that is kept; the cache starts anew beyond them.
CACHE, LONGEST = 32 << 20, 256


@dataclass
class Codec:
    """A rebuilt model with its checks."""

    #: The whole rebuilt tokenizer, and the same for chunks that are normalised already.
    tokenizer: object
    core: object
    decoder: object
    reference: object
    chunks: re.Pattern | None
    pieces: list[str]
    #: The bytes that a piece stands for.
    plain: list[bytes]
    prefix: bool
    known: dict[str, list[int]] = field(default_factory=dict)
    held: int = 0

    def encode(self, batch: list[str], verify: bool) -> tuple[list[list[int]], list[bool]]:
        """Token ids of texts, and whether they equal the SentencePiece library's (True unless verified)."""
        ids, same = self.encode_arrays(batch, verify)
        return [x.tolist() for x in ids], same

    def encode_arrays(self, batch: list[str], verify: bool) -> tuple[list[np.ndarray], list[bool]]:
        """The same with the ids as arrays of 32-bit integers."""
        if self.chunks is not None:
            ids = self._by_chunks(batch)
        else:
            ids = [np.array(e.ids if t else [], np.int32) for t, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))]
        if not verify:
            return ids, [True] * len(ids)
        return ids, [np.array_equal(a, b) for a, b in zip(ids, self.reference.encode_as_numpy(batch, num_threads=1))]

    def _by_chunks(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of texts, put together from those of the batch's distinct chunks by array lookups.

        Where single spaces part words without a marker, every word makes one chunk
        and Arrow cuts them; runs of spaces, markers and empty texts take the pattern.
        """
        given = pa.array(batch, pa.large_string())
        odd = pc.match_substring_regex(given, f"^ |  | $|{MARK}|^$").to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(batch)
        for rows, mark in ((np.flatnonzero(~odd), MARK), (np.flatnonzero(odd), "")):
            if mark:
                split = pc.split_pattern(given.take(pa.array(rows)), " ")
            else:
                split = pa.array([self.chunks.findall(MARK + batch[r].replace(" ", MARK)) if batch[r] else [] for r in rows], pa.large_list(pa.large_string()))
            for r, ids in zip(rows, self._look_up(split, mark)):
                out[r] = ids
        return out

    def _look_up(self, split: pa.Array, mark: str) -> list[np.ndarray]:
        """Ids of lists of chunks, the mark before each."""
        coded = split.flatten().dictionary_encode()
        distinct = [mark + c for c in coded.dictionary.to_pylist()]
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        known = self.known
        new = [c for c in distinct if c not in known]
        found = {c: e.ids for c, e in zip(new, self.core.encode_batch_fast(new, add_special_tokens=False))}
        each = [known[c] if c in known else found[c] for c in distinct]
        for c, x in found.items():
            if len(c) <= LONGEST:
                known[c] = x
                self.held += len(c) + 8 * len(x)
        flat = np.fromiter(chain.from_iterable(each), np.int32)
        starts = np.cumsum([0, *map(len, each)])
        places = coded.indices.to_numpy()
        lengths = np.diff(starts)[places]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        ids = flat[np.repeat(starts[places] - ends[:-1], lengths) + np.arange(ends[-1])]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        cuts = ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, batch: list) -> list[str]:
        """Texts of arrays or lists of tokens; valid runs of byte pieces become their characters."""
        return [self._decode(ids.tolist() if isinstance(ids, np.ndarray) else ids) if len(ids) else "" for ids in batch]

    def _decode(self, ids: list[int]) -> str:
        plain = self.plain
        try:
            text = b"".join(map(plain.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # broken runs of byte pieces: the library's replacement rule
            return self.decoder.decode([self.pieces[i] for i in ids])
        return text[1:] if self.prefix and text[:1] == " " else text


def threads() -> int:
    return max(1, int(os.environ.get("RAYON_NUM_THREADS", "2")))


@lru_cache(maxsize=4)
def build(model: bytes) -> Codec:
    """Rebuild a SentencePiece model (unigram or BPE) with the tokenizers library."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as protobuf
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    proto = protobuf.ModelProto()
    proto.ParseFromString(model)
    spec, trained, pieces = proto.normalizer_spec, proto.trainer_spec, list(proto.pieces)
    if trained.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if any(p.type == 4 for p in pieces):
        raise ValueError("models with user-defined pieces can't be rebuilt")
    unknown = next((i for i, p in enumerate(pieces) if p.type == 2), 0)
    if trained.model_type == 1:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unknown, trained.byte_fallback)
    else:
        core = models.BPE(
            vocab={p.piece: i for i, p in enumerate(pieces)},
            merges=merges(pieces),
            unk_token=pieces[unknown].piece,
            fuse_unk=True,
            byte_fallback=trained.byte_fallback,
        )
    simple = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    apart = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in pieces) and not trained.treat_whitespace_as_suffix
    plain_core, tokenizer = Tokenizer(core), Tokenizer(core)
    chunked = simple and apart and spec.add_dummy_prefix
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.add_dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return Codec(
        tokenizer,
        plain_core,
        tokenizer.decoder,
        SentencePieceProcessor(model_proto=model),
        re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if chunked else None,
        [p.piece for p in pieces],
        [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in pieces],
        spec.add_dummy_prefix,
    )


def merges(pieces: list) -> list[tuple[str, str]]:
    """Merges that a BPE model's scores imply: every split of a piece into two pieces, best piece first.

    SentencePiece takes the leftmost of equal scores.  Putting merges of long left
    parts first does the same for pieces of equal score that extend each other,
    such as runs of spaces.
    """
    rank = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
    score = {p.piece: p.score for p in pieces if p.type == 1}
    found = [(-score[p], -k, rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [x[4:] for x in sorted(found)]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than what may be broadcast")
    return model


def encode_texts(frame: DataFrame, text_col: str, model: bytes, ids_col: str = "ids", parity_col: str = "parity", verify: bool = True) -> DataFrame:
    """Append token ids of a text column, and whether they equal the SentencePiece library's."""
    shipped = frame.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in frame.schema.fields if f.name not in (ids_col, parity_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = build(shipped.value)
        for b in batches:
            ids, same = codec.encode_arrays([t or "" for t in b.column(text_col).to_pylist()], verify)
            arrays = [*(b.column(f.name) for f in kept), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), ids_col, parity_col])

    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(parity_col, T.BooleanType())])
    return frame.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, ids_col: str, model: bytes, text_col: str = "decoded") -> DataFrame:
    """Append the text of a column of token ids; null and empty lists decode to the empty text."""
    shipped = frame.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in frame.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = build(shipped.value)
        for b in batches:
            out = codec.decode([x or [] for x in b.column(ids_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out, pa.string())], [*(f.name for f in kept), text_col])

    return frame.mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"


def round_trips(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """Encode, verify and decode every text, and keep digests of what came out.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = build(shipped.value)
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.slice(k, 1000)
                given = part.column("text").to_pylist()
                ids, same = codec.encode_arrays(given, True)
                back = codec.decode(ids)
                yield batch(
                    DIGEST,
                    part.column("doc_id"),
                    [len(x) for x in ids],
                    [sha256(x.astype("<i4", copy=False).tobytes()).hexdigest() for x in ids],
                    [sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back],
                    [a == b for a, b in zip(given, back)],
                    same,
                )

    return texts(docs).mapInArrow(run, DIGEST)
