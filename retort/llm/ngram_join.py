"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

Plan, every step over all documents:

1. Sketch: how many documents hold a shingle, in 2**20 hashed counters. It only decides an order of shingles in
   which very common ones come last, so counting several shingles together costs time, never results.
2. Signature: by that order, the first ``n - ceil(t n) + slack(n)`` shingles of a set of n. Two sets of
   similarity t share at least ``slack`` of them (of the smaller set), so searching these lists loses no link.
3. Sets that are equal meet in one representative.
4. Collapse: a document is compared with the most typical document of each of its inverted lists, which joins most
   large groups of near copies without their pairs.
5. Search: lists that still hold several components are searched. Of each document's lists the longest ones, up to the
   needed overlap less one, are set aside; the others are heap-merged with skipping, and the documents found are
   binary-probed for the rest and kept if they reach the overlap (DivideSkip). A pair must also meet in the shortest
   prefixes that its two sizes allow, which spares most pairs of a group of near copies that are not similar enough.
6. Pairs that reach it are verified exactly on whole texts; components follow from the links.
7. Links, where they are asked for: both ends of one are in one component, so the sets of a component meet in blocks. In
   a task, each document's inverted lists in the other block are added up, and what reaches the overlap is a link.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retort.llm.common import as_bytes, cut, mix, shingle_sets, small
from retort.llm.components import components

_SLOTS = 1 << 20
_SLICE = 1 << 14
#: A list is long, and may be set aside, from this many documents on.
LONG = 64
#: A list is dealt out in chunks of about this many documents.
CHUNK = 1024
#: Documents that ask for a chunk together, about, and pairs of one document whose texts meet in one task.
ASKERS, PAIRS = 4096, 512
#: Ids that may be broadcast to prune a scan: 64 MB at most; more are joined by a shuffle.
BROADCAST_IDS = 2_500_000


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """``doc_id, h``: a row's text is found again by its id and the hash of the text, as rows of one id may differ."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), *more)


def _texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The text of each of some rows ``doc, doc_id, h``, once for every equal row: ``doc, text``, and what else they have."""
    return _keyed(docs, "text").join(named, ["doc_id", "h"])


def _slack(n):
    return 1 + n // 32


def _least(n, percent: int):
    """The least number of shingles that a set of n shares with a set linked to it."""
    return -(-percent * n // 100)


def _sketch(docs: DataFrame, width: int) -> bytes:
    """A bit for each of the hashed counters of shingles, set if it is very common; the driver gets these 128 kB, no counters."""

    def count(batches):
        total = np.zeros(_SLOTS, np.int32)
        for batch in batches:
            for s in shingle_sets(as_bytes(batch.column(0)), width):
                np.add.at(total, (s & np.uint64(_SLOTS - 1)).astype(np.int64), 1)
        yield from _slices(total)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts, np.int64 if len(counts) > 4 * _SLICE else np.int32).astype(np.int64)
        for at, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64())], names=["at", "counts", "total"])

    def _slices(total):
        for at in range(0, _SLOTS, _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + _SLICE].tobytes()], pa.binary())], names=["at", "counts"])

    def pick(batches):
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c, np.int64) > least).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["at", "bits"])

    kind = "at int, counts binary"
    parts = cut(docs.select("text").mapInArrow(count, kind).repartition("at").mapInArrow(add, f"{kind}, total long")).coalesce(_SLOTS // _SLICE // 4)
    mean = (parts.agg(F.sum("total")).first()[0] or 0) / _SLOTS
    least = mean + max(4 * LONG, 8 * mean**0.5)
    return b"".join(bytes(r["bits"]) for r in sorted(parts.mapInArrow(pick, "at int, bits binary").collect())).ljust(_SLOTS // 8, b"\0")


def _signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, hash of the text, number of shingles, 128-bit fingerprint of the set, its first shingles in the common order, and a row number."""
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(docs, width))
    salt = np.uint64(0xA0761D6478BD642F)

    def sign(batches):
        hot = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            n, one, two, tokens = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(as_bytes(batch.column(2)), width):
                    n.append(len(s))
                    one.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    two.append(int(mix(s ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    late = hot[(s & np.uint64(_SLOTS - 1)).astype(np.int64)]
                    order = np.concatenate((s[~late], s[late])) if late.any() else s
                    tokens.append(order[: len(s) - _least(len(s), percent) + _slack(len(s))].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            values = pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=["doc_id", "h", "n", "one", "two", "tokens"],
            )

    signed = _keyed(docs, "text").mapInArrow(sign, "doc_id long, h long, n long, one long, two long, tokens array<long>")
    return cut(signed.withColumn("row", F.monotonically_increasing_id()))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of representatives whose whole sets are similar enough.

    The second of many pairs is repeated, so that not all of them meet in one task.
    """
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(reps.select("doc", "doc_id", "h"), "doc"))
    texts = _texts(docs, small(ids, BROADCAST_IDS)).select("doc", "text")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("parts")).where("parts > 1")
    many = small(cut(many), BROADCAST_IDS)
    parts = F.coalesce("parts", F.lit(1))
    asked = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    second = texts.toDF("b", "text_b").join(many, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = asked.join(texts.toDF("a", "text_a"), "a").join(second, ["b", "part"])

    def verify(batches):
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            one, two = as_bytes(batch.column(1)), as_bytes(batch.column(3))
            keep = []
            for at in range(0, len(one), 256):
                part = list(zip(one[at : at + 256], two[at : at + 256], strict=True))
                new = [t for t in {t for pair in part for t in pair} if t not in known]
                if len(known) > 1024:
                    known.clear()
                    new = list({t for pair in part for t in pair})
                known.update(zip(new, shingle_sets(new, width), strict=True))
                for x, y in part:
                    x, y = known[x], known[y]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "text_a", "b", "text_b").mapInArrow(verify, "a long, b long")


def merge_skip(lists: list[list[int]], need: int) -> list[int]:
    """The values that at least ``need`` of the sorted lists hold, by a heap whose lists skip what can't reach it."""
    heap = [(values[0], k) for k, values in enumerate(lists) if values]
    heapq.heapify(heap)
    at = [0] * len(lists)
    found = []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            found.append(top)
            for k in popped:
                at[k] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            top = heap[0][0]
            for k in popped:
                at[k] = bisect_left(lists[k], top, at[k])
        for k in popped:
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return found


def _searched(rows: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of their first shingles.

    rows: token, pos (from 0, in the common order), doc, n, df (length of the token's list) and component, for tokens of
    several components. The pair's larger document, by size and then id, finds the smaller.
    """
    need = F.lit(1) + F.floor(-F.floor(F.col("n") * -percent / 100) / 32)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("df"), "token"))
    asked = rows.withColumn("rank", rank).withColumn("need", need).withColumn("long", (F.col("df") > LONG) & (F.col("rank") < F.col("need")))
    skipped = asked.groupBy("doc").agg(F.first("need").alias("need"), F.sum(F.col("long").cast("int")).alias("set_aside"))
    longest = rows.agg(F.max("df")).first()[0] or 1
    chunks = 1 << max(0, (longest // CHUNK - 1).bit_length())
    groups = F.ceil(F.col("df") / ASKERS)
    lists = (
        rows.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.lit(chunks)))
        .groupBy("token", "chunk").agg(F.array_sort(F.collect_list(F.struct("doc", "n", F.col("pos").alias("at"), "component"))).alias("list"), F.first("df").alias("df"))
        .select("token", "chunk", "list", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"))
    )
    asked = asked.withColumn("group", F.pmod(F.xxhash64("doc", F.lit(1)), groups))
    overlap = lambda x: -F.floor(-(F.col("n") + x["n"]) * percent / (100 + percent))
    fits = lambda x: (
        (x["component"] != F.col("component")) & (x["n"] * 100 >= F.col("n") * percent)
        & ((x["n"] < F.col("n")) | ((x["n"] == F.col("n")) & (x["doc"] < F.col("doc"))))
    )
    first = lambda x: (x["at"] <= x["n"] - overlap(x)) & (F.col("pos") <= F.col("n") - overlap(x))
    ids = lambda kept: F.transform(kept, lambda x: x["doc"])
    merged = (
        asked.select("token", "group", "pos", "doc", "n", "component", "long").join(lists, ["token", "group"])
        .select("doc", "chunk", "pos", "n", "long", F.filter("list", lambda x: fits(x) & (~F.col("long") | first(x))).alias("list")).where("size(list) > 0")
        .select("doc", "chunk", ids(F.col("list")).alias("list"), ids(F.filter("list", first)).alias("sure"))
        .groupBy("doc", "chunk").agg(F.collect_list("list").alias("lists"), F.array_distinct(F.flatten(F.collect_list("sure"))).alias("sure"))
        .where("size(sure) > 0").join(skipped, "doc")
        .select("doc", "lists", "sure", F.greatest(F.lit(1), F.col("need") - F.col("set_aside")).cast("int").alias("need"))
    )

    def merge(batches):
        for batch in batches:
            a, b = [], []
            for doc, lists, sure, need in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sure = set(sure)
                found = [x for x in merge_skip(lists, need) if x in sure]
                a += [doc] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = merged.mapInArrow(merge, "a long, b long")
    sides = signed.select("doc", "n", "tokens")
    probed = found.join(sides.toDF("a", "n_a", "tokens_a"), "a").join(sides.toDF("b", "n_b", "tokens_b"), "b")

    def probe(batches):
        for batch in batches:
            (xs, xo), (ys, yo) = (_flat(batch.column(k)) for k in (2, 4))
            n, m = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            keep = []
            for k in range(len(batch)):
                s, t = xs[xo[k] : xo[k + 1]], np.sort(ys[yo[k] : yo[k + 1]])
                both = -(-percent * (n[k] + m[k]) // (100 + percent))
                at = np.searchsorted(t, s)
                same = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(same >= max(1, min(len(s) - n[k], len(t) - m[k]) + both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return probed.select("a", "b", "tokens_a", "n_a", "tokens_b", "n_b").mapInArrow(probe, "a long, b long")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow column of lists."""
    offsets = np.asarray(lists.offsets)
    return np.asarray(lists.flatten()), offsets - offsets[0]


def _sets(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A representative of every distinct set, known by its row number ``doc``; ``doc, n, tokens`` of these; their tokens that several of them hold."""
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row", "h")).alias("first")
    reps = full.groupBy("one", "two", "n").agg(first, F.count("*").alias("size"))
    reps = cut(reps.select("one", "two", "n", F.col("first.row").alias("doc"), "first.doc_id", "first.h", "size"))
    copies = cut(full.select(F.col("row").alias("doc")).join(reps.select("doc"), "doc", "left_anti"))
    sets = full.select(F.col("row").alias("doc"), "n", "tokens").join(small(copies, BROADCAST_IDS), "doc", "left_anti")
    rows = sets.select("doc", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return reps, sets, cut(rows.join(shared, "token").select("token", "pos", "doc", "n", "df"))


#: Shingles of a block of a component whose links are counted, about.
SHINGLES = 1 << 18
#: Members of components that may be broadcast to choose their texts: 64 MB at most.
BROADCAST_MEMBERS = 800_000


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], percent: int):
    """For each set of one block, the positions of the sets of the other that are linked to it."""
    owner = np.repeat(np.arange(len(two)), [len(s) for s in two])
    tokens = np.concatenate(two)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(s) for s in two])
    for s in one:
        a, b = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
        n = b - a
        ends = np.cumsum(n)
        at = np.repeat(a - (ends - n), n) + np.arange(int(ends[-1]))
        same = np.bincount(owner[at], minlength=len(two))
        yield np.flatnonzero((same > 0) & (100 * same >= percent * (len(s) + sizes - same)))


def _within(final: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, emit, kind: str) -> DataFrame:
    """What ``emit(ids, sizes, found)`` makes of each tile: ids and numbers of copies of both blocks, and per set of the first its links in the second.

    Every pair of sets of a component is in one tile, once from either side where both sets are in one block.
    """
    members = final.select(F.col("node").alias("doc"), "component").join(reps.select("doc", "doc_id", "h", "n", "size"), "doc")
    groups = members.groupBy("component").agg(F.count("*").alias("count"), F.ceil(F.sum("n") / SHINGLES).alias("blocks")).where("count > 1").drop("count")
    placed = members.join(groups, "component").select("doc", "doc_id", "h", "size", "component", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"))
    placed = cut(placed)

    def packed(part):
        rows = _texts(docs, F.broadcast(part) if placed_small else part)
        return rows.groupBy("component", "block").agg(F.sort_array(F.collect_set(F.struct("doc", "size", "text"))).alias("rows"), F.first("blocks").alias("blocks"))

    placed_small = placed.count() <= BROADCAST_MEMBERS
    single = packed(placed.where("blocks = 1")).select("rows", F.lit(None).cast("array<struct<doc:bigint,size:bigint,text:string>>").alias("others"))
    several = packed(placed.where("blocks > 1"))
    left = several.withColumn("meet", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = several.select("component", F.col("block").alias("meet"), F.col("rows").alias("_others"))
    tiles = left.join(right, ["component", "meet"]).select("rows", F.when(F.col("block") != F.col("meet"), F.col("_others")).alias("others"))

    def sides(rows):
        first: dict[int, tuple[int, bytes]] = {}
        for r in rows:
            first.setdefault(r["doc"], (r["size"], (r["text"] or "").encode("utf-8", "surrogatepass")))
        return list(first), [size for size, _ in first.values()], list(shingle_sets([t for _, t in first.values()], width))

    def scan(batches):
        for batch in batches:
            for rows, others in zip(batch.column(0), batch.column(1), strict=True):
                ids, sizes, sets = sides(rows.as_py())
                if not others.is_valid:
                    own = [found[found != k] for k, found in enumerate(_overlaps(sets, sets, percent))]
                    yield emit(ids, sizes, ids, sizes, own, True)
                else:
                    ids2, sizes2, sets2 = sides(others.as_py())
                    yield emit(ids, sizes, ids2, sizes2, list(_overlaps(sets, sets2, percent)), False)

    return single.unionByName(tiles).mapInArrow(scan, kind)


def _near(final, reps, docs, width, percent) -> DataFrame:
    """``doc, near``: how many rows with another set are linked to each set."""

    def emit(ids, sizes, ids2, sizes2, found, own):
        near = [int(np.asarray(sizes2)[f].sum()) for f in found]
        doc = list(ids)
        if not own:
            back = np.zeros(len(ids2), np.int64)
            for size, f in zip(sizes, found, strict=True):
                back[f] += size
            doc, near = doc + list(ids2), near + back.tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(near, pa.int64())], names=["doc", "near"])

    return _within(final, reps, docs, width, percent, emit, "doc long, near long").groupBy("doc").agg(F.sum("near").alias("near"))


def representative_links(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """All links of ngram_jaccard_join() between representatives: ``a, b`` with a < b, each once.

    Its ``representative`` is the membership: documents are linked if they share it, or if theirs are a pair here.
    """
    reps, sets, rows = _sets(_signatures(docs, width, percent))
    final = cut(_collapsed(rows, sets, reps, docs, width, percent))

    def emit(ids, sizes, ids2, sizes2, found, own):
        pairs = [(a, ids2[k]) for a, f in zip(ids, found, strict=True) for k in f.tolist() if not own or a < ids2[k]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["one", "two"])

    names = reps.select(F.col("doc"), "doc_id")
    pairs = _within(final, reps, docs, width, percent, emit, "one long, two long")
    pairs = pairs.join(names.toDF("one", "_one"), "one").join(names.toDF("two", "_two"), "two")
    return pairs.select(F.least("_one", "_two").alias("a"), F.greatest("_one", "_two").alias("b"))


def ngram_jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """Links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs other than ASCII white space, A-Z lower-cased; a document of fewer words has its whole sequence as
    its one shingle. Returns a row per input row: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by
    links, its own included) and ``representative`` (smallest doc_id with the same set). With ``links`` a column
    ``n_links`` follows: the other rows that are linked to the row, exact copies included.

    Null, empty and blank texts have an empty set, link with nothing and keep their own id. Repeated rows and exact
    copies share a representative. Rows of one doc_id with different texts are documents each, linked by their own sets
    only. A null doc_id gets the component of its set's other rows, or null. Other columns are ignored; an empty table
    gives no rows. A shingle is told from others by a 64-bit hash, a set by a 128-bit one.
    """
    signed = _signatures(docs, width, percent)
    reps, sets, rows = _sets(signed)
    final = cut(_collapsed(rows, sets, reps, docs, width, percent))
    joined = _placed(final, reps)
    if links:
        counts = _near(final, reps, docs, width, percent)
        joined = joined.join(counts, "doc", "left").withColumn("linked", F.col("size") + F.coalesce("near", F.lit(0)))
    own = ["linked"] if links else []
    joined = joined.select("one", "two", "n", F.col("doc_id").alias("representative"), F.col("first.doc_id").alias("component_id"), *own)
    out = signed.select("doc_id", "n", "one", "two").join(joined, ["one", "two", "n"], "left")
    empty = F.col("n") == 0
    n_links = F.coalesce(F.col("linked") - F.col("doc_id").isNotNull().cast("long"), F.lit(0)).alias("n_links") if links else None
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("representative")).alias("representative"),
        *([n_links] if links else []),
    )


def _placed(final: DataFrame, reps: DataFrame) -> DataFrame:
    """The representatives with ``first``, the ``doc_id, h`` of the first one of their component."""
    placed = reps.join(final.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    return placed.join(first, "component").drop("component")


def _collapsed(rows: DataFrame, sets: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The components of the links between distinct sets, without searching inside those that the collapse has found."""
    typical = rows.groupBy("doc").agg(F.sum("df").alias("typical"))
    centers = rows.join(typical, "doc").groupBy("token").agg(F.max(F.struct("typical", "doc", "n")).alias("center"))

    near = rows.join(centers, "token").where("doc <> center.doc").groupBy(F.col("doc").alias("a"), F.col("center.doc").alias("b")).agg(
        F.count("*").alias("same"), F.first("n").alias("n"), F.first("center.n").alias("m")
    )
    smaller, larger = F.least("n", "m"), F.greatest("n", "m")
    near = cut(near.where((F.col("same") >= 1 + F.floor(smaller / 32)) & (smaller * 100 >= larger * percent)).select("a", "b"))
    links = cut(_verified(near, reps, docs, width, percent))
    first = components(links)

    placed = rows.join(first.select(F.col("node").alias("doc"), "component"), "doc", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    placed = cut(placed.join(mixed, "token"))
    found = cut(_searched(placed, sets, percent))
    more = _verified(found, reps, docs, width, percent)
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component, the row of the smallest doc_id, once.

    Keeps the columns of ``docs``, whatever their names. Rows with a null doc_id or without words are kept as they are.
    Rows of one doc_id with different texts are documents each: of those in one component, the one whose text has the
    smallest hash stays, once if repeated.
    """
    signed = _signatures(docs, width, percent)
    reps, sets, rows = _sets(signed)
    joined = _placed(cut(_collapsed(rows, sets, reps, docs, width, percent)), reps).select("one", "two", "n", "first")
    words = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h", "one", "two", "n")
    gone = words.join(joined, ["one", "two", "n"]).where("doc_id <> first.doc_id OR h <> first.h").select("doc_id", "h").distinct()
    again = cut(words.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "h"))
    named = _keyed(docs, F.struct(*docs.columns).alias("row"))
    kept = named.join(small(cut(gone), BROADCAST_IDS), ["doc_id", "h"], "left_anti")
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
        kept = kept.join(again, ["doc_id", "h"], "left_anti").unionByName(once)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op1_ngram_jaccard(spark, sf_dir):
    """The contract's digest of the join over all documents."""
    from retort.llm.common import documents

    return ngram_jaccard_join(documents(spark, sf_dir), links=True).select("doc_id", "n_shingles", "component_id", "n_links")
