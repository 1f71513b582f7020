"""What the operators share: checkpointing, table access and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """The named table of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder, with their lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; a private one is made only where none is set and all of Spark is
    one process.
    Spark's cleaner removes the files when the frame is no longer referenced.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all nodes share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="retort-checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int) -> DataFrame:
    """The frame with a broadcast hint if a count proves it to have at most ``limit`` narrow rows, else unhinted."""
    return F.broadcast(df) if df.count() <= limit else df


# --- arrays and places of a text, in DataFrame functions -------------------------------------------------------

#: Code points of a piece of a text; any place in a text is reached by its piece.
PIECE = 256


def let(value: Column, body) -> Column:
    """What ``body`` makes of a value that is worked out once, however often a lambda in it uses the value."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, fold) -> Column:
    """For each item the fold over the items before it; by blocks, so that n items take about n ** (4 / 3) steps."""
    zero = F.lit(0)

    def made(values):
        n = F.size(values)

        def by(width):
            blocks = F.transform(F.sequence(zero, F.greatest(n - 1, zero), width), lambda at: fold(F.slice(values, at + 1, width)))
            past = let(blocks, lambda b: F.transform(b, lambda _, k: fold(F.slice(b, F.lit(1), k))))
            return let(past, lambda p: F.transform(values, lambda _, k: fold(F.array(F.get(p, F.floor(k / width).cast("int")), fold(F.slice(values, (k - k % width) + 1, k % width))))))

        return let(F.greatest(F.lit(1), F.ceil(F.cbrt(n)).cast("int")), by)

    return let(values, made)


def total(values: Column) -> Column:
    """The sum of an array of int."""
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def most(values: Column) -> Column:
    """The largest of an array of int, 0 if there is none."""
    return F.coalesce(F.array_max(values), F.lit(0))


def pieces_of(text: Column) -> Column:
    """A text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def piece_slice(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text that was cut into pieces. Found by the piece: counting from the text's start takes too long."""
    k, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    near, far = F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, last), F.lit(""))
    across = F.concat(F.substring(near, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, k + 2, F.greatest(last - k - 1, F.lit(0))), ""), F.substring(far, F.lit(1), b % PIECE))
    return F.when(k == last, F.substring(near, a % PIECE + 1, b - a)).otherwise(across)


def count_of(spans: str, kind: str) -> Column:
    """How many of an array of spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


# --- hashing of words, vectorised over a block of texts -------------------------------------------------------

_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_factors: list[np.ndarray] = [np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes behave as random numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(n: int) -> np.ndarray:
    """A fixed random odd number for each of the first n positions of a word."""
    if len(_factors[0]) < n:
        with np.errstate(over="ignore"):
            _factors[0] = mix(np.arange(1, 2 * n + 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors[0]


def hashed(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whose letters follow each other: their sum, each times the random factor of its place, mixed.

    The factors follow no rule, so no pattern of letters makes different words collide, as powers of a base would.
    """
    if not len(sizes):
        return np.empty(0, np.uint64)
    at = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * factors(int(sizes.max()))[at], np.cumsum(sizes) - sizes))


def _hash_block(block: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a block of bytes, lower-cased (A-Z) or as it is."""
    b = np.frombuffer(block, np.uint8)
    b = _LOWER[b] if lower else b
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, hashed(b[word], end - start)


def _pieces(text: bytes):
    """A text in blocks of about a megabyte, cut at white space."""
    at = 0
    while len(text) - at > _BLOCK:
        end = at + _BLOCK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = True):
    """For each text, the hashes of its words in order, lower-cased (A-Z) or as they are. Texts are hashed together, a megabyte at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > _BLOCK:
            yield from _flush(held, lower)
            held, size = [], 0
            yield np.concatenate([_hash_block(p, lower)[1] for p in _pieces(text)])
            continue
        held.append(text)
        size += len(text) + 1
        if size > _BLOCK:
            yield from _flush(held, lower)
            held, size = [], 0
    yield from _flush(held, lower)


def _flush(held: list[bytes], lower: bool):
    if held:
        start, hashes = _hash_block(b" ".join(held), lower)
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(start, ends[:-1]))


def shingle_sets(texts: list[bytes], width: int):
    """For each text, the sorted distinct hashes of its ``width``-word shingles; of the whole sequence, if it is shorter."""
    old = np.seterr(over="ignore")
    try:
        for h in word_hashes(texts):
            if 0 < len(h) < width:
                x = np.full(1, len(h), np.uint64)
                for v in h:
                    x = mix(x * np.uint64(31) + v)
                yield x
            elif len(h):
                n = len(h) - width + 1
                g = h[:n]
                for k in range(1, width):
                    g = mix(g + np.uint64(2 * k + 1) * h[k : k + n])
                yield np.unique(g)
            else:
                yield h
    finally:
        np.seterr(**old)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; nulls are empty."""
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
