import zlib
from hashlib import sha256

from covista.llm import merkle, queries
from covista.llm.merkle import PersistentTree, depth, digest, fold, manifest

ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def path(leaves, at):
    """The top of a list of digests, and the siblings of one of them, by definition."""
    siblings = []
    while len(leaves) > 1:
        first = at // 3 * 3
        run = leaves[first:first + 3]
        siblings.append((run[:at - first], run[at - first + 1:]))
        leaves, at = [h(*leaves[i:i + 3]) for i in range(0, len(leaves), 3)], at // 3
    return leaves[0], siblings


def brute(rows):
    groups = {}
    for doc, text, lang, source, n in rows:
        groups.setdefault(source, []).append((doc, leaf(doc, source, lang, n, text), text, lang, n))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(r[1])))
    tops = [path([r[1] for r in groups[s]], 0)[0] for s in names]
    out = []
    for i, s in enumerate(names):
        root, above = path(tops, i)
        leaves = [r[1] for r in groups[s]]
        for at, (doc, own, text, lang, n) in enumerate(groups[s]):
            siblings = path(leaves, at)[1] + above
            other = text
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None:
                other = text.replace("\n", "")
            folded = leaf(doc, s, lang, n, other)
            for left, right in siblings:
                folded = h(*left, folded, *right)
            proof = h(*[x for pair in siblings for side in pair for x in side])
            out.append((doc, own, tops[i], root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def changed(spark, rows, **options):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, ROW).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("block", F.lit(0))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(df, tampered, F.translate("text", "\n", ""), **options)


def test_query_matches_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    want = brute([tuple(r) for r in docs.collect()])
    assert got(queries.op13_merkle(spark, sf)) == want
    assert {r[6] for r in want} == {True, False}


def test_odd_rows_in_small_blocks(spark, monkeypatch):
    rows = [(i, f"line {i}\nnext", "en", "hot" if i % 3 else f"s{i % 5}", i) for i in range(61)]
    rows += [(None, "a\nb", None, None, None), (None, None, "de", None, 1), (4, "", "en", "é", 0), (4, "", "en", "é", 0),
             (4, "x\n", "en", "é", 0), (70, "long " * 50_000 + "\n", "en", "Z", 5), (71, "alone", "en", "", 5)]
    want = brute(rows)
    assert got(changed(spark, rows)) == want
    # blocks of 9 leaves: several tables of blocks in both trees
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 9)
    blocks, versions, nodes = merkle._blocks, merkle._versions, merkle._node_paths

    def small(fn):
        def run(batches):
            import covista.llm.merkle as m
            m.BLOCK_LEVELS, m.BLOCK_LEAVES = 2, 9
            try:
                yield from fn(batches)
            finally:
                m.BLOCK_LEVELS, m.BLOCK_LEAVES = 7, 3 ** 7
        return run

    for name, fn in (("_blocks", blocks), ("_versions", versions), ("_node_paths", nodes)):
        monkeypatch.setattr(merkle, name, small(fn))
    assert got(changed(spark, rows)) == want


def test_untampered_rows_verify(spark):
    df = spark.createDataFrame([(i, "t\n", "en", "s", 1) for i in range(5)], ROW)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in manifest(df).collect())


def test_lone_leaf_and_empty_table(spark):
    one = manifest(spark.createDataFrame([(1, "x", "en", "s", 1)], ROW)).collect()
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == h()
    assert manifest(spark.createDataFrame([], ROW)).collect() == []


def test_versions_share_untouched_nodes():
    leaves = [digest(str(i)) for i in range(20)]
    tree = PersistentTree(leaves, depth(20))
    before, first = len(tree.hashes), list(tree.hashes)
    version = tree.with_leaf(tree.root, 7, digest("other"))
    assert len(tree.hashes) == before + 1 + depth(20)            # the leaf and its ancestors only
    assert tree.hashes[:before] == first                         # the first version is as it was
    assert tree.hashes[version] == PersistentTree(leaves[:7] + [digest("other")] + leaves[8:], depth(20)).hashes[-1]
    assert fold(digest("other"), *tree.siblings(tree.root, 7)) == tree.hashes[version]
    again = tree.with_leaf(version, 19, digest("more"))          # a version of a version
    assert tree.hashes[again] != tree.hashes[version]


def test_query_matches_oracle(spark, sf):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op13_merkle"])
    df = queries.op13_merkle(spark, sf)
    assert df.columns == want.columns and got(df) == sorted(want.fetchall(), key=str)
