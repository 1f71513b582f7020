"""Substring dedup: words of passages that repeat anywhere in the corpus, found by fixed-block anchors.

A window of w words holds a whole block of b = (w + 1) div 2 words of its document's non-overlapping blocks, wherever it
starts. So of two equal windows, each lies around a place of the other document whose next b words are that block.

1. Documents go in chunks, one compressed row each, written once; a chunk's words are hashed again in every step.
2. Anchors: the blocks are the index, and every rolling b-word window probes it. A chunk sends its different hashes, sorted,
   as compressed differences, to buckets of the hash range; blocks are marked. A bucket answers by a bit for each hash that is
   a block somewhere and occurs in more than one place. A hash is sent once a chunk, however often it occurs.
3. Extension: a hit reaches to both sides as far as w-word windows around it repeat. Windows that hold a hit are sent as 96-bit
   hashes in the same way, and each bucket answers by a bit for those that occur in more than one place; their union is the
   maximal repeats. No pairs of places are made, so a passage of thousands of copies costs what its words cost.
4. Covered words are left out of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut, documents, mix, word_hashes

#: Bytes of text of a chunk, about; a longer document is a chunk.
CHUNK = 8 << 20
#: Hashes of a bucket, about: at least so many where that leaves KEYS of each chunk, and never more than MOST.
LEAST, MOST, KEYS = 1 << 18, 1 << 22, 64
#: Bits of an anchor's hash beyond those that number all windows; others that share it are told apart in the extension.
SPARE = 14
_CHUNKS = "chunk long, doc_ids array<long>, sizes array<int>, texts binary, n_words long"
#: Two odd factors of rolling hashes, and their inverses.
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)
_powers: dict[int, np.ndarray] = {}


def _power(odd: int, n: int) -> np.ndarray:
    """The first powers of an odd number, in 64 bits; the longest row made is kept."""
    held = _powers.get(odd)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), odd, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = _powers[odd] = np.multiply.accumulate(held)
    return held[:n]


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place on, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = _ODD[which]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power(odd, len(words)), dtype=np.uint64)))
        return mix((sums[width:] - sums[:-width]) * _power(pow(odd, -1, 1 << 64), n))


def _packed(values: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(values, asbytes=True)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(packed, (n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n).astype(bool)


def pack_sorted(keys: np.ndarray, base: int) -> tuple[int, bytes]:
    """Sorted numbers from a base on as the byte planes of their differences: how many planes, and these, compressed."""
    steps = np.diff(keys, prepend=np.uint64(base))
    planes = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return planes, _packed(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unpack_sorted(n: int, base: int, planes: int, packed: bytes) -> np.ndarray:
    """The numbers that pack_sorted() was given."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(packed, n * planes, codec="zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


class Chunk:
    """The words of some documents after each other: their hashes, and the place where each one's document ends."""

    def __init__(self, row: dict):
        self.doc_ids, sizes = row["doc_ids"], row["sizes"]
        text = pa.decompress(row["texts"], sum(sizes), codec="zstd", asbytes=True)
        ends = np.cumsum([0, *sizes])
        self.texts = [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        hashes = list(word_hashes(self.texts, lower=False))
        self.counts = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.ends = np.cumsum(self.counts)

    def starts(self, width: int) -> np.ndarray:
        """For each place whether a window from it on stays in its document."""
        out = np.zeros(max(0, len(self.words) - width + 1), bool)
        for a, n in zip((self.ends - self.counts).tolist(), self.counts.tolist(), strict=True):
            out[a : max(a, a + n - width + 1)] = True
        return out

    def blocks(self, width: int) -> np.ndarray:
        """The places of the whole non-overlapping blocks of every document."""
        return np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + n - width + 1, width) for a, n in zip((self.ends - self.counts).tolist(), self.counts.tolist(), strict=True) if n >= width)])

    def anchors(self, width: int, bits: int):
        """The different rolling hashes, sorted; for each place that has one, its number; whether it is a block; whether it occurs twice."""
        at = np.flatnonzero(self.starts(width))
        keys = rolling(self.words, width)[at] >> np.uint64(64 - bits)
        known, number, times = np.unique(keys, return_inverse=True, return_counts=True)
        block = np.zeros(len(known), bool)
        block[number[np.searchsorted(at, self.blocks(width))]] = True
        return known, at, number, block, times > 1

    def windows(self, width: int, at: np.ndarray):
        """The different hashes of the windows from these places on, as two sorted arrays; each place's number; whether it occurs twice."""
        one, two = rolling(self.words, width)[at], rolling(self.words, width, 1)[at] >> np.uint64(32)
        order = np.lexsort((two, one))
        new = np.ones(len(at), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        return one[order[new]], two[order[new]], number, np.bincount(number, minlength=int(new.sum())) > 1


def chunked(docs: DataFrame) -> DataFrame:
    """The documents in chunks of about CHUNK bytes of text: ids, sizes and compressed texts in one row each."""

    def chunk(number, ids, texts):
        whole = b"".join(texts)
        words = sum(len(t.split()) for t in texts)
        values = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([_packed(whole, 9)], pa.binary()), pa.array([words], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "doc_ids", "sizes", "texts", "n_words"])

    def gather(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and size + len(text) > CHUNK:
                    yield chunk(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text)
        if ids:
            yield chunk(number, ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(gather, _CHUNKS)


def _sent(chunk: int, buckets: int, bits: int, keys: np.ndarray, flags: list[np.ndarray], more: np.ndarray | None = None):
    """A chunk's sorted keys of ``bits`` bits, cut into buckets of the key range: a row each."""
    if not len(keys):
        return
    shift = bits - (buckets.bit_length() - 1)
    ends = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(shift)) if buckets > 1 else np.empty(0, np.int64)
    ends = np.concatenate(([0], ends, [len(keys)]))
    filled = np.flatnonzero(np.diff(ends))
    rows = []
    for k in filled.tolist():
        part = slice(int(ends[k]), int(ends[k + 1]))
        planes, packed = pack_sorted(keys[part], k << shift)
        rows.append((chunk, k, part.stop - part.start, planes, packed, _packed(b"".join(np.packbits(f[part]).tobytes() for f in flags)), b"" if more is None else more[part].astype("<u4").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], names=["chunk", "bucket", "n", "planes", "keys", "flags", "more"])


_SENT = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_SENT_KIND = "chunk long, bucket long, n int, planes int, keys binary, flags binary, more binary"


def _answers(sent: DataFrame, blocks: bool) -> DataFrame:
    """For each chunk and bucket the bits of the hashes that occur in more than one place, and are a block somewhere if so asked.

    Keys are compared within their bucket, so from its base on.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "n", "planes", "keys", "flags", "more"]).to_pylist()
        keys = np.concatenate([unpack_sorted(r["n"], 0, r["planes"], r["keys"]) for r in rows])
        flags = [pa.decompress(r["flags"], (1 + blocks) * ((r["n"] + 7) // 8), codec="zstd", asbytes=True) for r in rows]
        flag = lambda k: np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8)[k * ((r["n"] + 7) // 8) :], count=r["n"]) for f, r in zip(flags, rows, strict=True)])
        more = None if blocks else np.concatenate([np.frombuffer(r["more"], "<u4") for r in rows])
        order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        if more is not None:
            new[1:] |= more[order[1:]] != more[order[:-1]]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        live = np.bincount(number, weights=1 + flag(0)) > 1
        if blocks:
            live &= np.bincount(number, weights=flag(1)) > 0
        found = live[number]
        out, at = [], 0
        for r in rows:
            own = found[at : at + r["n"]]
            at += r["n"]
            if own.any():
                out.append((r["chunk"], r["n"], _packed(np.packbits(own).tobytes())))
        bucket = table.column("bucket")[0].as_py() if len(rows) else 0
        columns = [pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.binary()))]
        return pa.Table.from_arrays([columns[0], pa.array([bucket] * len(out), pa.int64()), *columns[1:]], names=["chunk", "bucket", "n", "bits"])

    found = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, n int, bits binary")
    return found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answers"))


def _told(keys: np.ndarray, answers: list, buckets: int, bits: int) -> np.ndarray:
    """The bits that the buckets sent for a chunk's sorted keys."""
    shift = bits - (buckets.bit_length() - 1)
    out = np.zeros(len(keys), bool)
    for a in answers or ():
        at = int(np.searchsorted(keys, np.uint64(a["bucket"] << shift)))
        out[at : at + a["n"]] = _bits(a["bits"], a["n"])
    return out


def repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """Every document without the words of passages that occur elsewhere: ``doc_id, n_words, n_removed, kept``.

    Words are runs other than ASCII white space, unchanged. A word is removed if it is in a window of ``window``
    consecutive words of its document that also starts at any other place of any document, its own included;
    windows are judged on the input. ``kept`` is a binary column, the UTF-8 of the other words joined by one space.

    Returns a row per input row: null, empty and blank texts have no words and keep an empty text, shorter ones than
    a window stay whole, repeated rows and repeated doc_ids are documents each (and so repeat each other), a null
    doc_id stays null. Other columns are ignored; an empty table gives no rows. Windows are told apart by 96-bit hashes.
    A document is held whole by a task, about 100 bytes for each of its words.

    Each chunk sends a row to each bucket that it has hashes of. Up to some terabytes of text these rows hold KEYS hashes
    or more; beyond, raise CHUNK with the executors' memory, so that rows stay long.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    chunks = cut(chunked(docs))
    total, count = chunks.agg(F.sum("n_words"), F.count("*")).first()
    total = max(1, total or 0)
    wanted = max(total // MOST, min(total // LEAST, total // max(1, count) // KEYS), 1)
    buckets = 1 << (wanted - 1).bit_length()
    bits = min(64, max(total.bit_length() + SPARE, buckets.bit_length()))

    def probe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, _, is_block, twice = Chunk(row).anchors(block, bits)
                yield from _sent(row["chunk"], buckets, bits, keys, [twice, is_block])

    hits = _answers(chunks.mapInArrow(probe, _SENT_KIND), True)

    def extend(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                keys, at, number, _, _ = chunk.anchors(block, bits)
                live = np.zeros(len(chunk.words) + 1, np.int32)
                live[at[_told(keys, row["answers"], buckets, bits)[number]] + 1] = 1
                live = np.cumsum(live)
                starts = np.flatnonzero(chunk.starts(window))
                # a window holds a hit if one begins in its first words, so that all of the block is inside
                starts = starts[live[starts + (window - block) + 1] > live[starts]]
                if not len(starts):
                    continue
                one, two, _, twice = chunk.windows(window, starts)
                state = np.zeros(len(chunk.words), bool)
                state[starts] = True
                yield from _sent(row["chunk"], buckets, 64, one, [twice], two)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row["chunk"], -1, len(state), 0, _packed(np.packbits(state).tobytes()), b"", b""), _SENT, strict=True)], names=["chunk", "bucket", "n", "planes", "keys", "flags", "more"])

    sent = cut(chunks.join(hits, "chunk").select(*chunks.columns, "answers").mapInArrow(extend, _SENT_KIND))
    states = sent.where("bucket = -1").select("chunk", F.col("keys").alias("state"))
    told = states.join(_answers(sent.where("bucket >= 0"), False), "chunk")

    def leave_out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                gone = np.zeros(len(chunk.words) + 1, np.int64)
                if row["answers"]:
                    starts = np.flatnonzero(_bits(row["state"], len(chunk.words)))
                    one, _, number, _ = chunk.windows(window, starts)
                    starts = starts[_told(one, row["answers"], buckets, 64)[number]]
                    gone[starts] += 1
                    gone[starts + window] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                ids, removed, kept, size = [], [], [], 0
                for k, text in enumerate(chunk.texts):
                    out = covered[chunk.ends[k] - chunk.counts[k] : chunk.ends[k]]
                    n = int(out.sum())
                    words = text.split() if n < len(out) else []
                    kept.append(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o) if n and words else b" ".join(words))
                    removed.append(n)
                    ids.append(chunk.doc_ids[k])
                    size += len(kept[-1])
                    if size > CHUNK or k + 1 == len(chunk.texts):
                        n_words = chunk.counts[k + 1 - len(ids) : k + 1]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
                        ids, removed, kept, size = [], [], [], 0

    whole = chunks.join(told, "chunk", "left").select(*chunks.columns, "state", "answers")
    return whole.mapInArrow(leave_out, "doc_id long, n_words long, n_removed long, kept binary")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """As repeated_words(), ``kept`` being a text."""
    return repeated_words(docs, window).withColumn("kept", F.col("kept").cast("string"))


def op11_substring_dedup(spark, sf_dir):
    """The contract's digest over all documents."""
    return repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
g AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM p JOIN g USING (h)),
x AS (SELECT r, list(i) AS gone, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda t, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
