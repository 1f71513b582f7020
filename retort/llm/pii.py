"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidate spans; regex, gazetteer and context labelers vote on each; expectation-maximisation over the
counts of equal votes estimates how reliable each labeler is; the resulting soft labels train a logistic span
classifier. Votes and features take few values, so what the driver sees is a table of at most
``len(KINDS) * 3**4 * 2`` counts, however large the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import PIECE, before, count_of, cut, documents, let, most, piece_slice, pieces_of, total

# The certain kinds in their order, then the kinds that only the classifier reports.
BASE = ("email", "ip", "card", "phone")
WEAK = ("local_phone", "national_id", "iban")
KINDS = BASE + WEAK

# Each pattern is the leftmost greedy one, written so that no text makes it backtrack more than linearly or nest: what
# repeats is a class of characters, never a group. For emails the text is masked: a dot that no label follows is DOT.
DOT = "\x01"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "run": r"[0-9][0-9\x20-]{11,}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9+.()-])(?<!\+[0-9]{1,3}\x20)[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: What a text must hold for patterns of digits to be tried at all.
DIGITS = r"[0-9][0-9.\x20()-]{5,}[0-9]"

# Gazetteers: top-level domains, country calling codes, card issuers' first digits, IBAN countries.
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|ru|cn|jp|br|in|ca|au"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30[0-5]|3[68]"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
# Context: words that speak for and against personal data within CONTEXT code points before a span.
CONTEXT = 40
FOR = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|credit|ssn|social security|iban|account|address|ip|reach)\b"
AGAINST = r"(?i)\b(?:version|isbn|issn|serial|order|invoice|part|build|release|section|figure|table)\b"


def _masked(text: Column) -> Column:
    """The text with DOT for each dot that no label follows; a DOT that it holds becomes another control character."""
    return F.regexp_replace(F.translate(text, DOT, "\x02"), r"\.(?![A-Za-z0-9-])", DOT)


def _located(text: Column, pattern: str, tried: Column) -> Column:
    """The pattern's matches in a text as array of (start, end, hit), in code points."""
    kind = "array<struct<start:int,end:int,hit:string>>"
    placed = lambda hits, ends: F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
    steps = lambda hits: F.zip_with(hits, F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(hits)), lambda h, g: F.length(h) + g)
    ends = lambda hits: let(steps(hits), lambda s: F.zip_with(before(s, total), s, lambda a, b: a + b))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits, ends(hits))))
    return F.coalesce(F.when(tried, found), F.array().cast(kind))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _cards(runs: Column) -> Column:
    """Runs of digits with single separators, from runs with any: these are cut where separators repeat."""
    cutter = r"[\x20-]{2,}"

    def parts(run):
        gaps = F.transform(F.regexp_extract_all(run["hit"], F.lit(cutter), F.lit(0)), F.length)
        steps = lambda p: F.zip_with(p, gaps, lambda x, g: F.length(x) + F.coalesce(g, F.lit(0)))
        starts = lambda p: let(steps(p), lambda s: before(s, total))
        return let(F.split(run["hit"], cutter, -1), lambda p: F.zip_with(p, starts(p), lambda x, at: F.struct(
            (run["start"] + at).alias("start"), (run["start"] + at + F.length(x)).alias("end"), x.alias("hit"))))

    fit = lambda s: F.length(_digits(s["hit"])).between(13, 19) & F.call_function("luhn_check", _digits(s["hit"]))
    return F.filter(F.flatten(F.transform(runs, parts)), fit)


def _short(pieces: Column, at: Column, n: Column) -> Column:
    """Up to PIECE code points of a text from a place on; found by the piece, as counting from the start takes too long."""
    k = F.floor(at / PIECE).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit(""))), at % PIECE + 1, n)


def candidates(docs: DataFrame) -> DataFrame:
    """``_row, text, cands`` of rows ``_row, text``: every span of every kind with its labelers' votes (1 for, -1 against, 0 abstains).

    Spans of the certain kinds have passed their own test and come first, by kind and start.
    """
    df, text = docs, F.coalesce("text", F.lit(""))
    some = text.rlike(DIGITS)
    tried = {"email": text.contains("@"), "phone": text.contains("+"), "iban": text.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")}
    for name, pattern in PATTERNS.items():
        df = df.withColumn(name, _located(_masked(text) if name == "email" else text, pattern, tried.get(name, some)))
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").substr(1, 3).cast("int"), F.lit(0)) <= 255)
    df = df.withColumns({
        "email": F.transform("email", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.translate(s["hit"], DOT, ".").alias("hit"))),
        "ip": F.filter("ip", lambda s: F.forall(F.split(s["hit"], r"\."), small)),
        "card": _cards(F.col("run")),
        "phone": F.filter("phone", lambda s: F.length(_digits(s["hit"])).between(9, 15)),
    })

    plus, minus, zero = F.lit(1), F.lit(-1), F.lit(0)
    vote = lambda test: F.when(test, plus).otherwise(minus)
    form = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ip": r"^([1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
        "card": r"^[0-9]{4}([\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}$|^[0-9]{13,19}$", "phone": r"^\+[0-9]{1,3}[\x20(-]",
        "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20-]?[2-9]", "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}",
    }
    known = {
        "email": rf"(?i)\.({DOMAINS})$", "ip": r"^(?!0|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)", "card": rf"^({ISSUERS})", "phone": rf"^\+\(?({CALLING})",
        "local_phone": r"^\(?(?!555)", "national_id": r"^(?!123-45-6789|078-05-1120)", "iban": rf"^({IBAN_COUNTRIES})",
    }

    def voted(pieces: Column, k: int, name: str):
        def votes(s):
            context = _short(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT)))
            edges = F.concat(F.when(s["start"] > 0, _short(pieces, F.greatest(s["start"] - 1, F.lit(0)), F.lit(1))).otherwise(""), F.lit(" "), _short(pieces, s["end"], F.lit(1)))
            return F.struct(
                F.lit(k).alias("at"), F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                vote(s["hit"].rlike(form[name])).alias("regex"), vote(s["hit"].rlike(known[name])).alias("gazetteer"),
                F.when(context.rlike(FOR), plus).when(context.rlike(AGAINST), minus).otherwise(zero).alias("context"),
                F.when(edges.rlike(r"[\p{L}0-9]"), minus).otherwise(zero).alias("edges"),
            )

        return F.transform(name, votes)

    kind = "array<struct<at:int,kind:string,start:int,end:int,regex:int,gazetteer:int,context:int,edges:int>>"
    made = let(pieces_of(text), lambda pieces: F.concat(*(voted(pieces, k, name) for k, name in enumerate(KINDS))))
    some = sum((F.size(name) for name in KINDS), F.lit(0)) > 0
    return df.select("_row", "text", F.coalesce(F.when(some, made), F.array().cast(kind)).alias("cands"))


VOTES = ("regex", "gazetteer", "context", "edges")


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict]]:
    """Dawid-Skene EM over counts of vote vectors: the share of true spans, and per labeler P(vote | true or not).

    The start is a majority vote; every probability is smoothed, so that labelers that never vote do no harm.
    """
    soft = {v: 1 / (1 + math.exp(-1.5 * sum(v) - 0.5)) for v in counts}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        prior = (sum(soft[v] * n for v, n in counts.items()) + 1) / (total + 2)
        tables = []
        for k in range(len(VOTES)):
            table = {}
            for truth in (1, 0):
                mass = {x: 1.0 + (x == 1) * truth + (x == -1) * (1 - truth) for x in (-1, 0, 1)}
                for v, n in counts.items():
                    mass[v[k]] += n * (soft[v] if truth else 1 - soft[v])
                whole = sum(mass.values())
                table |= {(x, truth): m / whole for x, m in mass.items()}
            tables.append(table)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v[k], 1] / t[v[k], 0]) for k, t in enumerate(tables))
            soft[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables


def _posterior(votes, prior, tables) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[votes[k], 1] / t[votes[k], 0]) for k, t in enumerate(tables))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def span_classifier(table: list[tuple[tuple[int, tuple[int, ...]], int]], steps: int = 300) -> dict[tuple[int, tuple[int, ...]], float]:
    """Scores of every (kind, votes): a logistic model on kind and votes, fitted to the EM posteriors by their counts."""
    merged: dict[tuple[int, ...], int] = {}
    for (_, votes), n in table:
        merged[votes] = merged.get(votes, 0) + n
    prior, tables = reliabilities(merged)
    rows = [((kind, votes), n, _posterior(votes, prior, tables)) for (kind, votes), n in table]
    size = len(KINDS) + len(VOTES) + 1
    x = [[float(k == kind) * 0.5 for k in range(len(KINDS))] + [float(v) for v in votes] + [1.0] for (kind, votes), _, _ in rows]
    total = sum(math.sqrt(n) for _, n, _ in rows) or 1.0
    w = [0.0] * size
    for _ in range(steps):
        grad = [0.01 * a for a in w]
        for f, (_, n, target) in zip(x, rows, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))))
            for j in range(size):
                grad[j] += math.sqrt(n) / total * (p - target) * f[j]
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return {key: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) for f, (key, _, _) in zip(x, rows, strict=True)}


def _code(s) -> Column:
    """One number for a span's kind and votes."""
    out = s["at"]
    for name in VOTES:
        out = out * 3 + s[name] + 1
    return out


def _found(docs: DataFrame, least: float, keep_text: bool) -> DataFrame:
    """``_row, spans`` of rows ``_row, text``, and ``text`` if it is kept; what is found is written once, as votes are counted over all of it."""
    found = candidates(docs)
    found = cut(found if keep_text else found.drop("text"))
    votes = found.select(F.inline("cands")).groupBy("at", *VOTES).count().collect()
    scores = span_classifier([((r["at"], tuple(r[v] for v in VOTES)), r["count"]) for r in votes]) if votes else {}
    good = []
    for (at, vector), p in scores.items():
        code = at
        for v in vector:
            code = code * 3 + v + 1
        if at >= len(BASE) and p >= least:
            good.append(code)
    keep = lambda s: (s["at"] < len(BASE)) | _code(s).isin(*sorted(good)) if good else s["at"] < len(BASE)
    narrow = F.transform(F.filter("cands", keep), lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("_row", *(["text"] if keep_text else []), F.array_sort(narrow).alias("spans"))


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds personal-data spans to every document.

    Returns the columns of ``docs`` but ``text``, and ``spans``: an array of (at, kind, start, end), code points, end exclusive,
    by kind as in KINDS and then start. Certain kinds are always reported; the weak kinds where the trained classifier
    scores them at ``least`` or more. Null and empty texts have no spans; doc_id is not needed and may be null or
    repeated; other columns pass through, but for an own column ``spans``, which is replaced; an empty table gives no
    rows. No shuffle but for counts.
    """
    own = [c for c in docs.columns if c not in ("text", "spans")]
    found = _found(docs.select(F.struct(F.lit(0).alias("_none_"), *own).alias("_row"), "text"), least, False)
    return found.select(*(F.col("_row")[c].alias(c) for c in own), "spans")


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with each personal-data span replaced by its kind in square brackets; spans that overlap become one.

    All columns stay; ``n_chars``, if there, is the new length. Texts without spans, null texts included, are untouched.
    """
    names = docs.columns
    found = _found(docs.select(F.struct(F.lit(0).alias("_none_"), *(c for c in names if c != "text")).alias("_row"), "text"), least, True)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))

    def rewritten(spans):
        ends = before(F.transform(spans, lambda s: s["end"]), most)

        def parts(pieces):
            each = F.zip_with(spans, ends, lambda s, past: F.when(s["start"] < past, "").otherwise(F.concat(piece_slice(pieces, past, s["start"]), F.lit("["), s["kind"], F.lit("]"))))
            tail = piece_slice(pieces, most(F.transform(spans, lambda s: s["end"])), F.length("text"))
            return F.concat(F.array_join(each, ""), tail)

        return let(pieces_of(F.col("text")), parts)

    new = F.when(F.size("spans") > 0, let(by_start, rewritten)).otherwise(F.col("text"))
    out = found.withColumn("_new", new)
    columns = []
    for c in names:
        col = F.col("_new") if c == "text" else F.col("_row")[c]
        if c == "n_chars":
            col = F.when(F.size("spans") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(col)
        columns.append(col.alias(c))
    return out.select(*columns)


def written(spans: Column) -> Column:
    """kind:start:end in the order given, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """The contract's digest over all documents."""
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [count_of("spans", k).alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["at"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
