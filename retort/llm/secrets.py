"""Secret scanning: certain patterns anywhere, and weak candidates only where complementary parts co-occur."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import count_of, cut, documents

# The certain kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Weak parts, reported only next to their complement: identifiers, bare secrets, endpoints.
WEAK = ("ident", "bare", "endpoint")
IDENT = re.compile(r"(?ai:client_?id|user_?name|user|login|account_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})")
BARE = re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}")
#: Code points between the starts of parts that belong to one scope.
REACH = 300

ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "bare": "secret", "endpoint": "endpoint"}


def find_parts(text: str) -> list[tuple[str, int, int]]:
    """Certain spans and weak parts of a text, as (kind, start, end) in code points."""
    found = []
    marked = "=" in text or ":" in text
    if marked:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    idents = [("ident", *m.span()) for m in IDENT.finditer(text)] if marked else []
    if idents or any(kind == "access" for kind, *_ in found):
        found += idents
        found += [("bare", *m.span()) for m in BARE.finditer(text)]
    if "://" in text and any(ROLE[kind] != "endpoint" for kind, *_ in found):
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return found


def _written(spans):
    """kind:start:end by start, then kind as listed, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS + WEAK))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """Weak parts whose complement starts within ``reach`` code points, by an interval join on a grid.

    parts: the key columns, kind, start, end. An identifier or bare secret needs a part of the other role; an endpoint
    needs both an identifier and a secret. A grid cell is as wide as the reach, so of a cell of the same, the previous
    or the next column only its first and last start matter: the join meets at most three rows per role, however
    many parts a cell has.
    """
    roles = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    parts = parts.withColumn("role", roles[F.col("kind")]).withColumn("cell", F.floor(F.col("start") / reach))
    cells = parts.groupBy(*key, "role", "cell").agg(F.min("start").alias("first"), F.max("start").alias("last")).withColumnRenamed("role", "other")
    asked = parts.where(F.col("kind").isin(*WEAK)).withColumn("cell", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))))
    met = asked.join(cells, [*key, "cell"]).where(
        (F.col("other") != F.col("role"))
        & (F.abs(F.col("first") - F.col("start")).between(0, reach) | F.abs(F.col("last") - F.col("start")).between(0, reach)
           | ((F.col("first") <= F.col("start")) & (F.col("start") <= F.col("last"))))
    )
    seen = met.groupBy(*key, "kind", "start", "end", "role").agg(F.collect_set("other").alias("others"))
    complete = (F.col("role") == "endpoint") & (F.size(F.array_remove("others", "endpoint")) == 2)
    paired = (F.col("role") != "endpoint") & F.array_contains("others", F.when(F.col("role") == "id", "secret").otherwise("id"))
    return seen.where(complete | paired).select(*key, "kind", "start", "end")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Finds secrets in every whole text.

    Returns per row ``doc_id, n_assign, n_access, n_hex`` and ``base`` and ``found``: arrays of (kind, start, end) in code
    points, end exclusive, the certain spans and all spans with the linked weak ones. Null and empty texts have none.
    doc_id may be null or repeated: a row is known by its doc_id and text, and equal rows get equal results. Other
    columns are ignored. Texts are read once; only spans are shuffled.
    """

    def scan(batches):
        for batch in batches:
            found = [find_parts(t or "") for t in batch.column(2).to_pylist()]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], names=["doc_id", "row", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    rows = cut(narrow.mapInArrow(scan, f"doc_id {kind}, row long, spans array<struct<kind:string,start:int,end:int>>"))
    weak = rows.where(F.exists("spans", lambda s: s["kind"].isin(*WEAK))).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = weak.dropDuplicates(["id", "row"]).select("id", "row", F.inline("spans"))
    more = linked(parts, ["id", "row"], reach).groupBy("id", "row").agg(F.collect_list(F.struct("kind", F.col("start"), F.col("end"))).alias("more"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    out = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("base", base).join(more, ["id", "row"], "left")
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, "base", F.concat("base", F.coalesce("more", F.slice("base", 1, 0))).alias("found"))


def op3_secret_scans(spark, sf_dir):
    """The contract's digest of the scan over all documents."""
    out = scan_secrets(documents(spark, sf_dir))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))
