"""Op 6: secrets in documents, told apart by who owns their copies.

Pattern matches (the base) and high-entropy words are candidates.  The hash of each candidate's value
is counted over the whole corpus by distinct repositories and distinct owners: a value that many
owners hold is a copied example, one that stays with few owners looks like a live credential.  Base
spans are always reported; a high-entropy word is added (kind ``owned``) only where its value is not
an example.

Counts go by (value, owner, repository), then (value, owner), then value, each combined before its
shuffle, so a value found in a third of all rows is one row per task from the second step on.  Only
example values are joined back to candidates, as a written table, so the join can split hot values.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one
owner or repository of its own; repeated rows are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, texts

# The base patterns; letters of the assignment in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # a run of [0-9a-f]+ of 24 or more characters
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "owned")

WORD = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5        # bits a character of a high-entropy word
EXAMPLE_OWNERS = 3       # a value held by this many owners is an example
BROADCAST_CUTS = 500_000 # spans and rows of the largest broadcast: about 20 MB
EMPTY = hashlib.sha256(b"").hexdigest()


def entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the base matches, ordered by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list, min_entropy: float) -> list[tuple[int, int, int, str]]:
    """High-entropy words with letters and digits that touch no base span."""
    out = []
    for m in WORD.finditer(text):
        word = m[0]
        if (sum(c.isdigit() for c in word) >= 3 and sum(c.isalpha() for c in word) >= 3
                and entropy(word) >= min_entropy and all(e <= m.start() or s >= m.end() for s, _, e, _ in base)):
            out.append((m.start(), 3, m.end(), word))
    return out


def span_text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


SPAN = "struct<start:int,kind:int,end:int,value:binary>"
FOUND = f"doc_id bigint, owner string, repo string, text_key bigint, base_sha256 string, found array<{SPAN}>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))


def _scan(min_entropy: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, found = [], []
            for text in texts(batch, "text"):
                base = base_spans(text)
                shas.append(hashlib.sha256(span_text(base).encode()).hexdigest() if base else EMPTY)
                spans = sorted(base + entropy_spans(text, base, min_entropy))
                found.append([{"start": s, "kind": k, "end": e, "value": xxhash.xxh128_digest(v)} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("owner"), batch.column("repo"), batch.column("text_key"),
                 pa.array(shas, pa.string()), pa.array(found, SPAN_TYPE)],
                names=["doc_id", "owner", "repo", "text_key", "base_sha256", "found"])

    return run


def candidates(docs: DataFrame, owner: str = "source", repo: str = "doc_id", id_col: str = "doc_id",
               text_col: str = "text", min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """Per document its candidates, as a written table with a row number ``row``.  ``text_key`` is a
    hash of the text, by which findings can be joined to the documents again."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
                       F.col(repo).cast("string").alias("repo"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    return cut_lineage(map_batches(rows, _scan(min_entropy), FOUND)
                       .withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``value, owners, repos`` of every candidate value of the corpus."""
    each = found.select("owner", "repo", F.explode("found.value").alias("value"))
    return (each.distinct()
                .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
                .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, **options) -> DataFrame:
    """Per document ``doc_id, text_key, base_sha256`` and ``found``: its spans
    ``(start, kind, end, value, example)`` in order, example words of kind ``owned`` left out."""
    found = candidates(docs, **options)
    examples = cut_lineage(ownership(found).filter(F.col("owners") >= example_owners).select("value"), "examples")
    each = (found.filter(F.size("found") > 0).select("row", F.explode("found").alias("s"))
                 .select("row", "s", F.col("s.value").alias("value")))
    told = (each.join(examples.withColumn("example", F.lit(True)), "value", "left")
                .select("row", F.struct("s.start", "s.kind", "s.end", "s.value",
                                        F.coalesce("example", F.lit(False)).alias("example")).alias("s"))
                .filter((F.col("s.kind") != 3) | ~F.col("s.example"))
                .groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("told")))   # one document's spans
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:binary,example:boolean>>")
    return (found.drop("found").join(told, "row", "left")
                 .select("doc_id", "text_key", "base_sha256", F.coalesce("told", none).alias("found")))


def report(findings: DataFrame) -> DataFrame:
    """Counts and span texts of ``scan``'s rows."""
    def count(condition):
        return F.size(F.filter("found", condition)).cast("bigint")
    def of_kind(i):
        return lambda s: s.kind == i
    name = F.array(*[F.lit(k) for k in KINDS])
    return findings.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        "base_sha256",
        F.concat_ws(",", F.transform("found", lambda s: F.concat_ws(":", name[s.kind], s.start, s.end))).alias("spans"),
        count(lambda s: s.example).alias("n_example"), count(lambda s: ~s.example).alias("n_live"))


def _cut(mark: str, columns: list[str], text_col: str, length_col: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(texts(batch, text_col), batch.column("__spans").to_pylist()):
                parts, at = [], 0
                for start, end in spans:
                    if end > at:
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = end
                out.append("".join(parts) + text[at:])
            new = {text_col: out, length_col: list(map(len, out))}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c) for c in columns], names=columns)

    return run


def may_match(text: Column) -> Column:
    """True for every text with a candidate, and for some without: a test inside the scan's stage."""
    known = text.rlike("(?i)password|passwd|secret|token|api_?key") | text.contains("AKIA") | text.rlike("[0-9a-f]{24}")
    return known | (text.rlike("[0-9][^ \\n]*[0-9][^ \\n]*[0-9]") & text.rlike("[A-Za-z0-9+/_=-]{20}"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]", id_col: str = "doc_id",
           text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the spans that are not examples replaced by ``mark``; other rows stay untouched.
    ``length_col``, if given, takes the new length of a changed text.

    The rows to change are a small table; it is broadcast if it has at most ``BROADCAST_CUTS`` spans.
    Beyond that the join is a shuffle join of the texts that may hold a candidate (``may_match``, which
    lets no candidate through), and the other texts pass by."""
    live = F.transform(F.filter("found", lambda s: ~s.example), lambda s: F.array(s.start, s.end))
    cuts = (findings.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), live.alias("__spans"))
                    .filter(F.size("__spans") > 0).dropDuplicates(["__id", "__key"]))
    cuts = cut_lineage(cuts, "cuts")
    size = cuts.agg(F.sum(F.size("__spans") + F.lit(1))).first()[0] or 0
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key"))
    if size <= BROADCAST_CUTS:
        joined, rest = docs.join(F.broadcast(cuts), same, "left"), None
    else:
        possible = F.coalesce(may_match(F.col(text_col)), F.lit(False))
        joined, rest = docs.filter(possible).join(cuts, same, "left"), docs.filter(~possible)
    plain = joined.filter(F.col("__spans").isNull()).select(*docs.columns)
    marked = map_batches(joined.filter(F.col("__spans").isNotNull()).select(*docs.columns, "__spans"),
                         _cut(mark, docs.columns, text_col, length_col), docs.schema)
    out = plain.unionByName(marked)
    return out if rest is None else rest.unionByName(out)
