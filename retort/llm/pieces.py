"""SentencePiece encoding and decoding as a relational lattice.

The bounded-length substrings of a word are joined to the piece table; a word's matching edges are grouped and folded by
a higher-order aggregate; documents are put together from the words' pieces. The models here are of the BPE kind, whose
library result is not the path of highest total score: the fold therefore goes through a word's edges by descending
score and applies each that joins two present symbols. That equals merging the best adjacent pair again and again whenever
no piece of the model is itself merged out of order, which is tested on loading; words for which it is not known, very
long ones and runs of blanks, are merged pair by pair, by an exact heap.

A text is cut into words wherever no piece holds its two neighbouring characters, as no merge can go across. Frequent
words are encoded once and held by every worker, in arrays of bounded size. The other words go through the lattice with
the keys of their documents and meet these again in one shuffle, in which texts travel compressed. Which words are held
decides the speed, never the result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from retort.llm.common import cut, documents, hashed

#: Words up to this length have a lattice; an edge's ends are bits of one 64-bit number.
LONGEST = 60
#: Words that every worker holds, and their bytes, at most: the most frequent ones.
HELD, HELD_BYTES = 1 << 20, 1 << 25
#: A word that occurs less often is not worth a place.
LEAST = 3
#: Distinct words that a task counts before it sends them on.
COUNTED = 250_000
#: Characters that are cut into words at once, about.
SEGMENT = 1 << 17
#: Rows of a batch that a task takes up at once, so that what it makes of them stays small.
AT_ONCE = 512
#: Keys of documents that a row of an open word holds, about.
KEYS = 256
_MOD, _BASE = 2_147_483_647, 1_000_003


@dataclass(frozen=True)
class PieceModel:
    """Pieces with blanks for their markers, by id and score; the first of 256 byte ids; which characters join.

    ``classes`` numbers the characters of longer pieces by code point, 0 for all others; ``joins`` says, for a class times
    ``width`` plus a class, whether some piece holds the two characters side by side.
    """

    pieces: dict[str, tuple[int, float]]
    byte: int
    odd: tuple[str, ...]
    classes: np.ndarray
    joins: np.ndarray
    width: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def merged(word: str, pieces: dict[str, tuple[int, float]], trace: list | None = None) -> list[str]:
    """A word's symbols after merging the adjacent pair of highest score, leftmost first, again and again."""
    n = len(word)
    part: list[str | None] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i, j):
        if i >= 0 and j < n and (p := pieces.get(part[i] + part[j])):
            heapq.heappush(heap, (-p[1], i, part[i], part[j]))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        score, k, x, y = heapq.heappop(heap)
        j = after[k]
        if part[k] != x or j >= n or part[j] != y:
            continue
        part[k], part[j] = x + y, None
        if trace is not None:
            trace.append(score)
        after[k] = j = after[j]
        if j < n:
            before[j] = k
        offer(before[k], k)
        offer(k, j)
    return [p for p in part if p is not None]


def load_pieces(path: str) -> PieceModel:
    """Reads a SentencePiece BPE model with byte fallback, identity normalisation and a blank put before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte = {}, None
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            byte = k if byte is None else byte
        elif not (model.is_control(k) or model.is_unknown(k)):
            pieces[model.id_to_piece(k).replace("▁", " ")] = (k, model.get_score(k))
    if byte is None or any(" " in p.lstrip(" ") for p in pieces) or model.get_piece_size() > 65_535:
        raise ValueError("needs byte fallback, pieces that hold blanks only at their start, and ids of 16 bits")
    letters = sorted({c for p in pieces if len(p) > 1 for c in p})
    number = {c: k + 1 for k, c in enumerate(letters)}
    classes, width = np.zeros(ord(letters[-1]) + 2, np.int32), len(letters) + 1
    for c, k in number.items():
        classes[ord(c)] = k
    joins = np.zeros(width * width, bool)
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            joins[number[a] * width + number[b]] = True
    odd = []
    for p in pieces:
        if len(p) > 2 and "  " not in p:
            trace: list = []
            if merged(p, pieces, trace) != [p] or trace != sorted(trace):
                odd.append(p)
    return PieceModel(pieces, byte, tuple(odd), classes, joins, width)


def _table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """The pieces of two characters and more: piece, rank by descending score. At most as many rows as the model has pieces."""
    order = sorted((p for p in model.pieces if len(p) > 1), key=lambda p: (-model.pieces[p][1], model.pieces[p][0]))
    return spark.createDataFrame([(p, k) for k, p in enumerate(order)], "piece string, rank int").coalesce(1)


# --- cutting texts into words, vectorised ----------------------------------------------------------------------


def _segments(text: str | None) -> list[str]:
    """A text as it is encoded, a blank before it and markers as blanks, in parts; none ends within a word."""
    if not text:
        return []
    text, out, at = " " + text.replace("▁", " "), [], 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        while 0 < (end := text.find(" ", end)) and text[end - 1] == " ":
            end += 1
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _rows(batches):
    """The batches in smaller ones, copied, so that a large one is freed before the next is read."""
    for batch in batches:
        for k in range(0, len(batch), AT_ONCE):
            yield batch.take(pa.array(range(k, min(k + AT_ONCE, len(batch)))))
        del batch


def _groups(texts: list[str | None]):
    """Documents next to each other, as lists of (position, parts), about SEGMENT characters at a time."""
    held, size = [], 0
    for k, text in enumerate(texts):
        parts = _segments(text)
        held.append((k, parts))
        size += sum(map(len, parts))
        if size > SEGMENT:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hashes_of(units: list[str]) -> np.ndarray:
    """The hashes of whole words."""
    return hashed(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(u) for u in units]))


@dataclass
class Words:
    """Code points of some parts put together; start, length and 64-bit hash of every word, and how many each part has."""

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def text(self, k: int) -> str:
        return self.points[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes().decode("utf-32-le", "surrogatepass")


def cut_words(parts: list[str], model: PieceModel) -> Words:
    """The words of parts that are not empty; no word goes across two of them."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    code = model.classes[np.minimum(points, len(model.classes) - 1)]
    fresh = np.ones(len(points), bool)
    fresh[1:] = ~model.joins[code[:-1] * model.width + code[1:]]
    fresh[ends[:-1]] = True
    starts = np.flatnonzero(fresh)
    sizes = np.diff(starts, append=len(points))
    return Words(points, starts, sizes, hashed(points, sizes), np.diff(np.searchsorted(starts, ends), prepend=0))


def word_counts(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``unit, n``: words that occur more than once, and their counts; what a task sees once in COUNTED words is left out.

    Only words that have a lattice are counted. The counts choose the words to hold, which changes no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        model = shared.value
        known, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        texts: dict[int, str] = {}
        new: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settled():
            every, where = np.unique(np.concatenate([known, *(h for h, _ in new)]), return_inverse=True)
            return every, np.bincount(where, np.concatenate([counts, *(n for _, n in new)]), len(every)).astype(np.int64)

        def flushed():
            every, n = settled()
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array([texts[h] for h in every[often].tolist()], pa.string()), pa.array(n[often])], names=["unit", "n"])

        for batch in _rows(batches):
            for group in _groups(batch.column(0).to_pylist()):
                for parts, _ in _blocks(group):
                    words = cut_words(parts, model)
                    one, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                    fine = words.sizes[first] <= LONGEST
                    one, first, n = one[fine], first[fine], n[fine]
                    at = np.minimum(np.searchsorted(known, one), max(len(known) - 1, 0))
                    hit = known[at] == one if len(known) else np.zeros(len(one), bool)
                    counts[at[hit]] += n[hit]
                    new.append((one[~hit], n[~hit]))
                    waiting += len(one) - int(hit.sum())
                    for h, k in zip(one[~hit].tolist(), first[~hit].tolist(), strict=True):
                        if h not in texts:
                            texts[h] = words.text(k)
                    if waiting > 20_000 + len(known) // 4:
                        known, counts = settled()
                        new, waiting = [], 0
                    if len(texts) > COUNTED:
                        yield flushed()
                        known, counts, new, waiting = known[:0], counts[:0], [], 0
                        texts.clear()
        yield flushed()

    return docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _blocks(group):
    """The parts of a group and the positions of their documents, a few at a time; a part that is long comes alone."""
    held, owners, size = [], [], 0
    for k, parts in group:
        for p in parts:
            if held and size + len(p) > 2 * SEGMENT:
                yield held, owners
                held, owners, size = [], [], 0
            held.append(p)
            owners.append(k)
            size += len(p)
    if held:
        yield held, owners


# --- the lattice ----------------------------------------------------------------------------------------------


def _edges(words: DataFrame, model: PieceModel, key: list[str], carry: list[str]) -> DataFrame:
    """``key, carry, unit, edge``: every substring of a word that is a longer piece, as a number; its first character has a null edge.

    What is carried stands in the row of the first character, the others hold null.
    """
    table = F.broadcast(_table(words.sparkSession, model))
    once = lambda test: [f"CASE WHEN {test} THEN {c} END AS {c}" for c in carry]
    starts = words.selectExpr(*key, *carry, "unit", "explode(sequence(0, greatest(length(unit) - 2, 0))) AS s")
    spans = starts.selectExpr(*key, *once("s = 0"), "unit", "s", f"explode(sequence(CASE WHEN s = 0 THEN 1 ELSE 2 END, least({model.longest}, length(unit) - s))) AS l")
    met = spans.join(table, F.expr("substring(unit, s + 1, l) = piece"), "left").where("rank IS NOT NULL OR l = 1")
    # an edge is one number, in the order of the fold: rank, start, length
    return met.selectExpr(*key, *once("l = 1"), "unit", "shiftleft(cast(rank AS bigint), 12) | shiftleft(s, 6) | l AS edge")


def encode_words(words: DataFrame, model: PieceModel, key: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``unit, key, carry, cuts``: how words of up to LONGEST characters fall into pieces, by the lattice and its fold.

    Bit k of ``cuts`` is set where a piece starts or ends at character k. The fold starts from single characters and goes through
    the edges by rank; an edge whose ends are cuts, with one cut between, takes that one away. ``unit`` and ``key`` are
    unlike in all rows; where the rows are dealt by them, nothing is shuffled.
    """
    key, carry = key or [], carry or []
    grouped = _edges(words, model, key, carry).groupBy("unit", *key)
    lattice = grouped.agg(*(F.first(c, ignorenulls=True).alias(c) for c in carry), F.collect_list("edge").alias("edges"))
    at, size = "cast(shiftright(x, 6) & 63 AS int)", "cast(x & 63 AS int)"
    return lattice.selectExpr("unit", *key, *carry, f"""aggregate(sort_array(edges), shiftleft(1L, length(unit) + 1) - 1, (cuts, x) ->
        CASE WHEN bit_count(shiftright(cuts, {at}) & (shiftleft(2L, {size}) - 1)) = 3 AND (shiftright(cuts, {at}) & 1) = 1 AND (shiftright(cuts, {at} + {size}) & 1) = 1
        THEN cuts & ~shiftleft(shiftleft(1L, {size} - 1) - 1, {at} + 1) ELSE cuts END) AS cuts""")


def _far(unit: str, model: PieceModel) -> bool:
    """Whether a word is merged by the heap: too long for the lattice, a run of blanks, or with a piece out of order."""
    return len(unit) > LONGEST or unit.startswith("  ") or any(p in unit for p in model.odd)


def _ids(parts: list[str], model: PieceModel) -> list[int]:
    """The ids of pieces; a character that is none is spelled in bytes."""
    ids: list[int] = []
    for p in parts:
        if p in model.pieces:
            ids.append(model.pieces[p][0])
        else:
            ids += [model.byte + b for b in p.encode("utf-8", "surrogatepass")]
    return ids


def _parted(unit: str, cuts: int) -> list[str]:
    """The pieces of a word between its cuts."""
    at = [k for k in range(len(unit) + 1) if cuts >> k & 1]
    return [unit[a:b] for a, b in zip(at, at[1:], strict=False)]


@dataclass
class Held:
    """Words by hash, ascending, and their ids: those of word k are ``ids[ends[k] : ends[k + 1]]``; others occur less than ``least`` times."""

    hashes: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    least: int

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are of held words, and the places of these."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return hit, at[hit]


def frequent(docs: DataFrame, model: PieceModel) -> Held:
    """The most frequent words with their ids, at most HELD and HELD_BYTES of them."""
    counts = cut(word_counts(docs, model).where(F.col("n") >= LEAST).where("NOT startswith(unit, '  ')"))
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long")).alias("level")
    sizes = counts.groupBy(level).agg(F.count("*").alias("words"), F.sum(F.octet_length("unit") + 12).alias("bytes")).collect()
    least, words, size = None, 0, 0
    for r in sorted(sizes, reverse=True):
        words, size = words + r["words"], size + r["bytes"]
        if words > HELD or size > HELD_BYTES:
            break
        least = r["level"]
    if least is None:
        return Held(np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint16), LEAST)
    # dealt by word before they are spread to edges, so that these are not shuffled
    chosen = counts.where(F.col("n") >= least).select("unit").repartition("unit")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ready(batches):
        model = shared.value
        for batch in batches:
            words = [(u, c) for u, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not _far(u, model)]
            if words:
                ids = [np.array(_ids(_parted(u, c), model), np.int32) for u, c in words]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(_hashes_of([u for u, _ in words]).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], names=["hash", "ids"])

    out = encode_words(chosen, model).select("unit", "cuts").mapInArrow(ready, "hash long, ids array<int>").toArrow()
    hashes = out.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    ids = out.column(1).combine_chunks().take(pa.array(order))
    flat, ends = np.asarray(ids.flatten()).astype(np.uint16), np.asarray(ids.offsets).astype(np.int64)
    return Held(hashes[order], ends - ends[0] if len(order) else np.zeros(1, np.int64), flat, int(least))


# --- documents ------------------------------------------------------------------------------------------------


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of a pool put together, and where each ends."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _encoded_parts(words: Words, held: Held, model: PieceModel, cuts: dict[str, int], known: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The ids of each part. ``cuts`` has the words that went through the lattice; ``known`` keeps the ids of words that are not held."""
    hit, at = held.places(words.hashes)
    starts, sizes = np.zeros(len(hit), np.int64), np.ones(len(hit), np.int64)
    starts[hit], sizes[hit] = held.ends[at], held.ends[at + 1] - held.ends[at]
    pool = held.ids
    if not hit.all():
        miss = np.flatnonzero(~hit)
        one, first, back = np.unique(words.hashes[miss], return_index=True, return_inverse=True)
        own = []
        for h, k in zip(one.tolist(), miss[first].tolist(), strict=True):
            if h not in known:
                text = words.text(k)
                known[h] = np.array(_ids(_parted(text, cuts[text]) if text in cuts else merged(text, model.pieces), model), np.uint16)
            own.append(known[h])
        own_sizes = np.array([len(x) for x in own])
        starts[miss], sizes[miss] = (len(pool) + np.cumsum(own_sizes) - own_sizes)[back], own_sizes[back]
        pool = np.concatenate((pool, *own))
    flat, ends = _gathered(pool, starts, sizes)
    return np.split(flat, np.concatenate(([0], ends))[np.cumsum(words.counts)[:-1]])


def encode_documents(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Adds ``ids`` (array of int) to the columns of ``docs``: the pieces of every whole text, as the library gives them.

    Null and empty texts have no ids; the same text always gets the same ids. Any doc_id, repeated rows and an empty table
    are fine. An own column ``ids`` is replaced; other columns stay. Every row is shuffled once, its text compressed.
    """
    own = [c for c in docs.columns if c != "ids"]

    def whole(batch, texts, ids, words):
        columns = [texts if c == "text" else batch.column(k) for k, c in enumerate(own)]
        return pa.RecordBatch.from_arrays([*columns, ids], names=[*own, "ids"])

    return _encoded(docs.select(*own), model, whole, f"{_kind(docs, own)}, ids array<int>")


def _kind(docs: DataFrame, own: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)


def _open_words(docs: DataFrame, shared) -> DataFrame:
    """``key, unit`` of ``key, text``: the words of each text that are not held and have a lattice, once."""

    def find(batches):
        held, model = shared.value
        for batch in _rows(batches):
            keys = batch.column(0).to_pylist()
            for group in _groups(batch.column(1).to_pylist()):
                found: dict[tuple[int, int], str] = {}
                for parts, owners in _blocks(group):
                    words = cut_words(parts, model)
                    hit, _ = held.places(words.hashes)
                    miss = np.flatnonzero(~hit)
                    owner = np.repeat(owners, words.counts)[miss]
                    for d, h, k in zip(owner.tolist(), words.hashes[miss].tolist(), miss.tolist(), strict=True):
                        if (d, h) not in found:
                            found[d, h] = words.text(k)
                rows = [(keys[d], u) for (d, _), u in found.items() if not _far(u, model)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([u for _, u in rows], pa.string())], names=["key", "unit"])

    return docs.mapInArrow(find, "key long, unit string")


def _encoded(docs: DataFrame, model: PieceModel, finish, kind: str) -> DataFrame:
    """What ``finish`` makes of some rows of ``docs``, their texts, the ids of each whole text and its number of words.

    Rows are known by a hash of their columns that have one, so copies of a text with other columns go separate ways. Rows
    that share a hash share their open words, which changes nothing.
    """
    held = frequent(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast((held, model))
    own = docs.columns
    at = own.index("text")
    plain = [c for c in own if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    keyed = docs.select(F.xxhash64(*plain).alias("key"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(own)))

    # a row of an open word has some of the keys of its documents; with many, the word has more rows
    part = F.pmod("key", F.lit(max(1, held.least // KEYS)))
    units = _open_words(keyed.select("key", f"_{at}"), shared).groupBy("unit", part.alias("part")).agg(F.collect_list("key").alias("keys"))
    found = encode_words(units, model, ["part"], ["keys"]).select(F.explode("keys").alias("key"), F.struct("unit", "cuts").alias("word"))
    found = found.groupBy("key").agg(F.collect_list("word").alias("words"))

    def pack(batches):
        codec = pa.Codec("zstd")
        for batch in _rows(batches):
            texts = [None if t is None else (len(b := t.encode("utf-8", "surrogatepass")), codec.compress(b, asbytes=True)) for t in batch.column(at + 1).to_pylist()]
            columns = [*batch.columns, pa.array([None if t is None else t[0] for t in texts], pa.int64())]
            columns[at + 1] = pa.array([None if t is None else t[1] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "size"])

    types = [("binary" if k == at else docs.schema[c].dataType.simpleString()) for k, c in enumerate(own)]
    packed = keyed.mapInArrow(pack, "key long, " + ", ".join(f"_{k} {t}" for k, t in enumerate(types)) + ", size long")

    def assemble(batches):
        held, model = shared.value
        codec = pa.Codec("zstd")
        for batch in _rows(batches):
            sizes, words = batch.column(len(own)), batch.column(len(own) + 1)
            texts = [t if t is None else codec.decompress(t, n, asbytes=True).decode("utf-8", "surrogatepass") for t, n in zip(batch.column(at).to_pylist(), sizes.to_pylist(), strict=True)]
            for group in _groups(texts):
                cuts, known = _cuts(words.slice(group[0][0], len(group))), {}
                made, counts = [[] for _ in group], [0] * len(group)
                for parts, owners in _blocks(group):
                    cut_up = cut_words(parts, model)
                    for d, ids, n in zip(owners, _encoded_parts(cut_up, held, model, cuts, known), cut_up.counts.tolist(), strict=True):
                        made[d - group[0][0]].append(ids)
                        counts[d - group[0][0]] += n
                flat = [x for ids in made for x in ids]
                ends = np.cumsum([0, *(sum(map(len, ids)) for ids in made)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)))
                yield finish(batch.slice(group[0][0], len(group)), pa.array(texts[group[0][0] : group[0][0] + len(group)], pa.string()), ids, pa.array(counts, pa.int64()))

    return packed.join(found, "key", "left").select(*(f"_{k}" for k in range(len(own))), "size", "words").mapInArrow(assemble, kind)


def _cuts(words: pa.ListArray) -> dict[str, int]:
    """The cuts of the words of some documents, from their lists of (unit, cuts)."""
    rows = words.flatten()
    return dict(zip(rows.field(0).to_pylist(), rows.field(1).to_pylist(), strict=True)) if len(rows) else {}


def decode_ids(rows: DataFrame, model: PieceModel, column: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text that ids stand for: pieces and bytes put together; ids of neither vanish, broken bytes are replaced.

    The blank put before a text is part of the result. Null ids give null; all columns stay. A map, without a shuffle.
    """
    own = [c for c in rows.columns if c != name]
    at = own.index(column)
    parts = {k: p.encode() for p, (k, _) in model.pieces.items()} | {model.byte + b: bytes([b]) for b in range(256)}
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def decode(batches):
        known = shared.value
        for batch in _rows(batches):
            out = [None if ids is None else b"".join([known.get(k, b"") for k in ids]).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*own, name])

    return rows.select(*own).mapInArrow(decode, f"{_kind(rows, own)}, `{name}` string")


def _powers(n: int) -> np.ndarray:
    """The first powers of the digest's base, at least n."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * (int(out[-1]) * _BASE % _MOD) % _MOD))
    return out


def encoding_digests(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, n_words, n_tokens, ids, ids_digest, round_trip`` of every whole text, a row per row, as encode_documents() has it.

    ``ids_digest`` folds all ids of the text in their order: d -> (d * 1,000,003 + id + 1) mod (2**31 - 1), from 0.
    ``round_trip`` says that decoding the ids of the text gives its bytes back, a blank put before and markers as blanks.
    Null and empty texts: 0, 0, no ids, 0, true. Other columns are ignored.
    """
    parts = {k: p.encode() for p, (k, _) in model.pieces.items()} | {model.byte + b: bytes([b]) for b in range(256)}
    shared = docs.sparkSession.sparkContext.broadcast([parts.get(k, b"") for k in range(max(parts) + 1)])
    held: dict[str, object] = {}

    def digest(batch, texts, ids, words):
        if not held:
            held.update(parts=pa.array(shared.value, pa.large_binary()), powers=_powers(1))
        flat, ends = np.asarray(ids.values), np.asarray(ids.offsets).astype(np.int64)
        n = np.diff(ends)
        if len(held["powers"]) < n.max(initial=0):
            held["powers"] = _powers(int(n.max()))
        left = np.repeat(ends[1:], n) - 1 - np.arange(len(flat))
        sums = np.concatenate(([0], np.cumsum((flat.astype(np.int64) + 1) * held["powers"][left] % _MOD)))
        total = (sums[ends[1:]] - sums[ends[:-1]]) % _MOD
        decoded = held["parts"].take(ids.values)
        at = np.frombuffer(decoded.buffers()[1], np.int64)[ends] if len(flat) else np.zeros(len(ends), np.int64)
        spelled = memoryview(decoded.buffers()[2] or b"").cast("B")
        back = []
        for k, text in enumerate(texts.to_pylist()):
            wanted = (" " + text.replace("▁", " ")).encode("utf-8", "surrogatepass") if text else b""
            back.append(spelled[at[k] : at[k + 1]] == wanted)
        made = [words, pa.array(n, pa.int64()), ids, pa.array(total, pa.int64()), pa.array(back, pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "n_tokens", "ids", "ids_digest", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs.select("doc_id", "text"), model, digest, f"doc_id {kind}, n_words long, n_tokens long, ids array<int>, ids_digest long, round_trip boolean")


def op5_sentencepiece(spark, sf_dir):
    """Encodes all documents with the public 32k model and decodes the ids of each: the ids, and whether they decode to the text."""
    import public_tokenizers

    return encoding_digests(documents(spark, sf_dir).select("doc_id", "text"), load_pieces(str(public_tokenizers.path("piece_bpe_32k.model"))))
