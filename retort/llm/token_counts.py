"""Token counts of byte-level byte-pair encodings, by heap-and-linked-list merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from retort.llm.common import documents

#: Counts of pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 1 << 18
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge_count(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after merging the adjacent pair of lowest rank, leftmost first, again and again."""
    n = left = len(symbols)
    if n < 2:
        return n
    part: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        j = after[k]
        if part[k] is None or j >= n or ranks.get((part[k], part[j])) != rank:
            continue
        part[k] += part[j]
        part[j] = None
        left -= 1
        after[k] = j = after[j]
        if j < n:
            before[j] = k
            if (r := ranks.get((part[k], part[j]))) is not None:
                heapq.heappush(heap, (r, k))
        if (i := before[k]) >= 0 and (r := ranks.get((part[i], part[k]))) is not None:
            heapq.heappush(heap, (r, i))
    return left


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Counts the tokens of every whole text under the byte-level BPE file at ``path`` (JSON, read on the driver).

    Returns per row ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens). Nothing is truncated and no
    token is added; a special token's string inside a text is that one token, as the library does by default. Null and
    empty texts have 0 bytes and tokens. doc_id may be null or repeated; other columns are ignored. The work is a
    map over the table: no shuffle, and a worker holds one batch and a bounded memory of pre-tokens.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec["added_tokens"] if t["special"]]
    shared = docs.sparkSession.sparkContext.broadcast(({pair: k for k, pair in enumerate(merges)}, special))

    def count(batches):
        import regex

        ranks, special = shared.value
        table = byte_symbols()
        split = regex.compile(_SPLIT).findall
        apart = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        young: dict[str, int] = {}
        old: dict[str, int] = {}

        def tokens(word: str) -> int:
            nonlocal young, old
            if (n := old.get(word)) is None:
                n = merge_count("".join([table[b] for b in word.encode("utf-8", "surrogatepass")]), ranks)
            if len(word) < 64:
                if len(young) >= REMEMBERED:
                    young, old = {}, young
                young[word] = n
            return n

        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                parts = apart.split(text) if apart else [text]
                total = len(parts) - 1
                for part in parts:
                    for word in split(part):
                        n = young.get(word)
                        total += tokens(word) if n is None else n
                counts.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir):
    """Counts over all documents with the public 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))
