"""Registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _public(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share with others: only documents with such a passage have rows."""
    from .substring_dedup import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op2_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    from .decontamination import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain finds toxic, with the chain's probabilities."""
    from .toxicity import CUT, toxicity
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.filter(F.col("p_toxic") >= F.lit(CUT))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from .quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with the ownership verdicts."""
    from .secret_scan import report, scan
    return report(scan(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import as_hex, near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    from .topk import exact_topk
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the token files written from all documents."""
    from .token_files import token_ids
    return token_ids(table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"), digest=True)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the piece ids of every document, encoded and decoded."""
    from .piece_codec import digests
    return digests(table(spark, sf_dir, "documents"), _public("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 8 leading components of their whitening."""
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of all documents, with a digest of its ids."""
    from .packing import pack, report
    return report(pack(table(spark, sf_dir, "documents"), _public("byte_bpe_50k.json")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; half of them are checked with a text that lost its line feeds."""
    from .merkle import manifest
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(2) == F.lit(0)
    return manifest(table(spark, sf_dir, "documents"), tampered, F.translate("text", "\n", ""))


QUERIES = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_contaminated": op2_contaminated,
    "op3_toxic_documents": op3_toxic_documents,
    "op4_quality": op4_quality,
    "op5_html_main_text": op5_html_main_text,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_exact_topk": op8_exact_topk,
    "op9_token_files": op9_token_files,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_merkle": op13_merkle,
}



def _field(name: str) -> str:
    return f"coalesce(strlen(cast({name} AS varchar)) || ':' || {name}, '-')"


_FIELDS = ", ".join(f"{_field(c)} AS {a}" for c, a in zip(("doc_id", "source", "lang", "n_chars"), "abcd")) + ", text"
# a run's digests with the folded one in its place, and those beside it
_FOLD = "sha256(array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = w.idx % 3 + 1 THEN folded ELSE h END), ''))"
_BESIDE = "beside || array_to_string(list_filter(hs, lambda h, i: i <> w.idx % 3 + 1), '')"

ORACLE_SQL: dict[str, str] = {
    "op8_exact_topk": """
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
term AS (SELECT row, vec_id, unnest(w) AS weight, unnest(range(len(w))) AS term FROM ok),
pair AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, cast(sum(q.weight * c.weight) AS bigint) AS score
  FROM term q JOIN term c ON c.term = q.term AND c.row <> q.row
  WHERE q.vec_id % 50 = 0 GROUP BY q.row, c.row, q.vec_id, c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pair)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_merkle": f"""
WITH RECURSIVE
row AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_FIELDS}, translate(text, chr(10), '') AS other,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 2 = 0 AS tampered
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(head || {_field("text")}) AS leaf,
         CASE WHEN tampered THEN sha256(head || {_field("other")}) ELSE sha256(head || {_field("text")}) END AS other
  FROM (SELECT *, a || b || c || d AS head FROM row)),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS key,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaf),
nodes AS (
  SELECT tree, 0 AS lvl, idx, leaf AS h, n FROM numbered
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes
  WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM high
  WHERE n > 1 GROUP BY lvl, idx // 3, n),
runs AS (SELECT tree, lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM high WHERE n > 1 GROUP BY ALL),
way AS (
  SELECT key, tree, 0 AS lvl, idx, n, other AS folded, '' AS beside FROM numbered
  UNION ALL
  SELECT key, w.tree, w.lvl + 1, w.idx // 3, (n + 2) // 3, {_FOLD}, {_BESIDE}
  FROM way w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.idx // 3 WHERE n > 1),
high_way AS (
  SELECT key, 0 AS lvl, t.idx, t.n, folded, beside, t.h AS subroot FROM way w JOIN tops t ON t.tree = w.tree WHERE w.n = 1
  UNION ALL
  SELECT key, w.lvl + 1, w.idx // 3, (n + 2) // 3, {_FOLD}, {_BESIDE}, subroot
  FROM high_way w JOIN high_runs r ON r.lvl = w.lvl AND r.run = w.idx // 3 WHERE n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM numbered JOIN high_way w USING (key) JOIN high ON high.n = 1 WHERE w.n = 1""",
}
