import pytest

from covista.params import Params
from covista.runtime import cut_lineage, drop_table, ensure_checkpoint_dir
from covista.sources import fixtures, sinks, tables, text

SF = "/root/testdata/sf0.001"
STATS = "sub_category string, sku1 long, sku2 long, pv1 long, pv2 long, com long, total long, pot1 long, pot2 long, pot_joint long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pair_stats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A b", 1, 2, 5, 6, 3, 100, 50, 60, None), ("C", 3, 4, 5, 6, 2, 90, 1, 2, 3)], STATS)
    sinks.write_pair_stats(df, str(tmp_path / "s"))
    assert rows(text.read_pair_stats(spark, str(tmp_path / "s")).fillna(-1)) == rows(df.fillna(-1))


def test_pairs_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 2, 5, 6, 3, 9)], "sub_category string, sku1 long, sku2 long, pv1 long, pv2 long, com long, total long")
    sinks.write_pairs_json(df, str(tmp_path / "j"))
    assert rows(text.read_pairs_json(spark, str(tmp_path / "j"))) == rows(df)


def test_cluster_table_names(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, "1-0", "x", "u"), ("B", 2, "1-1", None, None)],
                               "sub_category string, SKU long, ClusterID string, SubSubCat string, path string")
    sinks.write_cluster_table(df, str(tmp_path / "c"), Params.production())
    names = sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir())
    assert names == ["file=clusPV_A_4_8_50", "file=clusPV_B_4_8_50"]
    lines = [line for f in (tmp_path / "c" / names[0]).glob("*.csv") for line in f.read_text().splitlines()]
    assert lines == ["1,1-0,x,u"]


def test_images_are_unique(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, None, "z")], "sku long, image_url string, sub_sub_category string")
    assert sorted((r.sku, r.image_url, r.sub_sub_category) for r in tables.dedupe_sku_images(df).collect()) == [(1, "b", "y"), (2, None, "z")]


def test_delimited_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text(" 1\t2 \n\n3,4\nx,5\n")
    assert sorted(map(str, text.read_delimited(spark, str(tmp_path / "v.txt"), text.SKU_VISITS).collect())) == sorted([
        "Row(sku=1, visitor=2)", "Row(sku=3, visitor=4)", "Row(sku=None, visitor=5)"])


class Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, master, named=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named} if named else {}


def test_a_cluster_without_a_shared_folder_raises(tmp_path):
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session("spark://host:7077"))
    assert ensure_checkpoint_dir(Session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert ensure_checkpoint_dir(Session("local[2]"), str(tmp_path / "f")) == str(tmp_path / "f")


def test_written_tables_can_be_dropped(spark):
    df = cut_lineage(spark.range(3))
    assert df.count() == 3
    drop_table(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._covista_path).count()


def test_stages_build_only_what_is_asked(spark, monkeypatch):
    from covista.plans import pipeline, registry
    written = []
    real = pipeline.cut_lineage
    monkeypatch.setattr(pipeline, "cut_lineage", lambda df, label="table": written.append(label) or real(df, label))
    registry.q_sku_pairs(spark, "/root/testdata/sf0.001").count()
    assert written == ["visitors", "kept", "pairs"]


def test_product_metrics_deal_rows_before_they_are_grouped(spark, monkeypatch):
    """No task groups a whole file split by product and order."""
    plain = sorted(map(tuple, fixtures.product_metrics(spark, SF).collect()), key=str)
    monkeypatch.setattr(fixtures, "TASK_ROWS", 1000)
    df = fixtures.product_metrics(spark, SF)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    lowest = plan[plan.rindex("HashAggregate"):]
    assert "REPARTITION_BY_NUM" in lowest and "hashpartitioning(l_partkey" in lowest
    assert sorted(map(tuple, df.collect()), key=str) == plain
