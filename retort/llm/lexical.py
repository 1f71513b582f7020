"""Ranked lexical search: documents grouped by the mask of an item's terms they hold, masks evaluated by descending bound.

Plan:

1. Items go in groups whose terms are proved to fit every worker; each group is one pass over the documents.
2. A map turns documents into blocks of postings of the group's terms: ids, counts, lengths. Blocks are written once.
3. Numbers of documents, of terms and of each term's documents are sums over the blocks.
4. In a block, an item's matched-term masks are bitmaps over the documents, packed to bytes. Documents of one mask are a
   group with one greatest possible score; masks are evaluated by descending bound until the k-th best score found is
   above what is left. The best of all blocks are merged by a ranked window, which Spark limits before its shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import as_bytes, cut, documents

#: A term: ASCII digits and letters, and all bytes of other characters, of a text whose A-Z are lower-cased.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents of a block, and their postings, at most (a longer document is a block).
DOCUMENTS, POSTINGS = 2048, 1 << 19
#: Bytes of the items' different terms that one pass holds; more take more passes.
VOCABULARY = 16 << 20
#: Documents that are scored together at first; each further step takes twice as many.
TOGETHER = 64
#: Documents times terms of an item that are looked at together.
CELLS = 1 << 21


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return _TERM.findall(text.lower())


def _counted(items: DataFrame) -> DataFrame:
    """``item_id, terms, times``: the different terms of each different row of the items, with their occurrences."""
    rows = items.where("item_id is not null").select("item_id", "text").distinct()

    def count(batches):
        for batch in batches:
            found = [Counter(terms_of(t)) for t in as_bytes(batch.column(1))]
            terms, times = ([list(part) for part in parts] for parts in ((c.keys() for c in found), (c.values() for c in found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    return rows.mapInArrow(count, f"item_id {dict(rows.dtypes)['item_id']}, terms array<binary>, times array<long>")


def _passes(items: DataFrame):
    """The items group by group, each as {item: {term: times}}; a group's terms take VOCABULARY bytes, or are one item's."""
    counted = cut(_counted(items))
    size = counted.agg(F.sum(F.aggregate("terms", F.lit(64).cast("long"), lambda a, t: a + F.length(t) + 64))).first()[0] or 0
    parts = -(-size // VOCABULARY)
    for part in range(parts):
        out: dict = {}
        for row in counted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toLocalIterator():
            terms = out.setdefault(row["item_id"], Counter())
            for term, times in zip(row["terms"], row["times"], strict=True):
                terms[bytes(term)] += times
        yield {item: terms for item, terms in out.items() if terms}


def _posted(docs: DataFrame, ids) -> DataFrame:
    """Blocks of documents that have a term: ``docs, doc_ids, lengths, sizes, terms, counts, df_terms, df`` and ``all_docs, all_terms``.

    ``ids`` is the broadcast number of each term that is asked for. Documents with terms, but none of these, are only counted.
    """

    def block(held, every):
        terms = np.concatenate([t for _, _, t, _ in held]) if held else np.empty(0, np.int32)
        counts = np.concatenate([c for *_, c in held]) if held else np.empty(0, np.int32)
        seen, df = np.unique(terms, return_counts=True)
        values = [
            pa.array([[d for d, *_ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, _, _ in held]], pa.list_(pa.int64())),
            pa.array([np.array([len(t) for *_, t, _ in held], np.int32).tobytes()]), pa.array([terms.tobytes()]), pa.array([counts.tobytes()]),
            pa.array([seen], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int64())), pa.array([every[0]], pa.int64()), pa.array([every[1]], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["doc_ids", "lengths", "sizes", "terms", "counts", "df_terms", "df", "all_docs", "all_terms"])

    def post(batches):
        number, held, every, size = ids.value, [], [0, 0], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at in range(0, len(own), 64):
                for doc, text in zip(own[at : at + 64], as_bytes(batch.column(1).slice(at, 64)), strict=True):
                    found = Counter(terms_of(text))
                    if not found:
                        continue
                    n = found.total()
                    every = [every[0] + 1, every[1] + n]
                    known = [t for t in found if t in number]
                    if known:
                        held.append((doc, n, np.array([number[t] for t in known], np.int32), np.array([found[t] for t in known], np.int32)))
                        size += len(known)
                    if len(held) >= DOCUMENTS or size >= POSTINGS:
                        yield block(held, every)
                        held, every, size = [], [0, 0], 0
        if every[0]:
            yield block(held, every)

    kind = "doc_ids array<long>, lengths array<long>, sizes binary, terms binary, counts binary, df_terms array<int>, df array<long>, all_docs long, all_terms long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, kind)


def best_by_masks(present: np.ndarray, gains: np.ndarray, weights: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions and scores of the k best rows of a block: score is ``gains @ weights``, ties go by ``order``.

    Rows are grouped by their mask, the packed bits of the terms they hold. No row of a group scores more than its terms
    with the greatest gain each has in the block. Groups are evaluated by descending bound, until what is left is below
    the k-th best score; a group that reaches it is evaluated, as a tie may go to its rows.
    """
    packed = np.packbits(np.pad(present, ((0, 0), (0, -present.shape[1] % 64))), axis=1).view(np.uint64)
    by = np.lexsort(packed.T)
    new = np.concatenate(([True], (packed[by[1:]] != packed[by[:-1]]).any(1)))
    masks, group = packed[by[new]], np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    bits = np.unpackbits(masks.view(np.uint8), axis=1, count=present.shape[1])
    bound = (bits.astype(np.int64) @ (weights * gains.max(0, initial=0)))[group]
    rows = np.argsort(-bound, kind="stable")
    at, step, score = 0, max(TOGETHER, k), np.empty(0, np.int64)
    while at < len(rows) and (at < k or bound[rows[at]] >= np.partition(score, at - k)[at - k]):
        part = rows[at : at + step]
        score = np.concatenate((score, gains[part] @ weights))
        at, step = at + len(part), 2 * step
    found = rows[:at]
    first = np.lexsort((order[found], -score))[:k]
    first = first[score[first] > 0]
    return found[first], score[first]


def _searched(blocks: DataFrame, items: dict, number: dict, df: dict, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """Each block's k best documents of each item: ``item_id, doc_id, score``."""
    asked = []
    for item, terms in items.items():
        held = sorted((number[t], times) for t, times in terms.items() if df.get(number[t]))
        if held:
            ids, times = np.array(held, np.int64).T
            found = np.array([df[int(t)] for t in ids], np.float64)
            weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * found + 1))).astype(np.int64)
            asked.append((item, ids, times * weight))
    sent, cells = blocks.sparkSession.sparkContext.broadcast(asked), CELLS
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, terms, counts = (np.frombuffer(row[c], np.int32) for c in ("sizes", "terms", "counts"))
                if not len(sizes):
                    continue
                doc_ids, lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
                order = np.empty(len(doc_ids), np.int64)
                order[sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))] = np.arange(len(doc_ids))
                m = 100 - 25 + (25 * lengths * n_docs) // n_terms
                doc = np.repeat(np.arange(len(sizes)), sizes)
                tf = counts.astype(np.int64)
                gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
                by = np.argsort(terms, kind="stable")
                terms, doc, gain = terms[by], doc[by], gain[by]
                items_, docs_, scores = [], [], []
                for item, ids, weights in sent.value:
                    a, b = np.searchsorted(terms, ids), np.searchsorted(terms, ids, side="right")
                    n = b - a
                    if not n.sum():
                        continue
                    ends = np.cumsum(n)
                    at = np.repeat(a - (ends - n), n) + np.arange(int(ends[-1]))
                    column = np.repeat(np.arange(len(ids)), n)
                    matched = np.zeros(len(sizes), bool)
                    matched[doc[at]] = True
                    rows, at_row = np.flatnonzero(matched), (np.cumsum(matched) - 1)[doc[at]]
                    width = max(1, cells // len(ids))
                    for low in range(0, len(rows), width):
                        part, here = rows[low : low + width], (at_row >= low) & (at_row < low + width)
                        present, gains = np.zeros((len(part), len(ids)), bool), np.zeros((len(part), len(ids)), np.int64)
                        present[at_row[here] - low, column[here]] = True
                        gains[at_row[here] - low, column[here]] = gain[at[here]]
                        best, score = best_by_masks(present, gains, weights, order[part], k)
                        items_ += [item] * len(best)
                        docs_ += [doc_ids[r] for r in part[best]]
                        scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items_, arrow), pa.array(docs_, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    return blocks.select("doc_ids", "lengths", "sizes", "terms", "counts").mapInArrow(search, f"item_id {kind}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: ``item_id, rank, doc_id, score``; none is missed.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Terms are runs of ASCII letters and digits and of all
    other characters than ASCII, A-Z lower-cased. With N documents that have a term, L terms in all of them, n in a document,
    df documents with a term and tf of it in the document, the score sums over the item's terms, repeats included,
    ``floor(1000 ln((2N + 2) / (2 df + 1))) * ((10**9 tf) div (1000 tf + 12 m))``, m being ``75 + (25 n N) div L``.

    Equal scores go by ascending doc_id, null last. Rows of ``docs`` are documents each, repeated ids and texts too; null and
    empty texts have no terms and count for nothing. Equal rows of ``items`` are one, different texts of an item_id make one
    item together; items without item_id, text or known terms get no rows, and a term that nearly all documents hold may
    weigh nothing. Other columns are ignored; empty tables give no rows. Whole texts are searched, of any length.
    """
    kind = dict(items.dtypes)["item_id"]
    context, out = docs.sparkSession.sparkContext, None
    for asked in _passes(items):
        if not asked:
            continue
        number = {t: i for i, t in enumerate(dict.fromkeys(t for terms in asked.values() for t in terms))}
        # dealt anew, as a document's postings are few beside its text and blocks take long to search
        blocks = cut(_posted(docs, context.broadcast(number)).repartition(4 * context.defaultParallelism))
        n_docs, n_terms = blocks.agg(F.sum("all_docs"), F.sum("all_terms")).first()
        if not n_docs:
            continue
        counts = blocks.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df").alias("df"))
        df = dict(map(tuple, counts.collect()))  # a number for each term of this pass
        found = _searched(blocks, asked, number, df, n_docs, n_terms, k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark, sf_dir):
    """The contract's search for all benchmark items in all documents."""
    return ranked_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, len(t) AS n, t FROM w WHERE len(t) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, t AS term, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT nn FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
q AS (SELECT item_id, t AS term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
g AS (SELECT q.item_id, d.doc_id, p.r,
             sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * d.n * s.nn) // s.ll))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d ON d.r = p.r CROSS JOIN s GROUP BY q.item_id, d.doc_id, p.r),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
