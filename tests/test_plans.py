"""The shape of the plans: what must not appear at scale."""

import re

import pytest
from pyspark.sql import functions as F

from gondola.operators import dimensions, duplicates, reports
from gondola.session import prepare
from workload import registry
from workload import tables as t
from workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["top_cheapest", "top_promotions"])
def test_top_prices_are_taken_before_the_joins(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("lineitem.parquet") == 1
    # read upwards: the scan of the prices, then the cut, and only then a shuffle
    above = plan[: plan.index("lineitem.parquet")].splitlines()
    nodes = [re.sub(r"^[^A-Za-z]*(\(\d+\) )?", "", line) for line in reversed(above)]
    first = next(n for n in nodes if n.startswith(("Exchange", "TakeOrderedAndProject", "SortMergeJoin")))
    assert first.startswith("TakeOrderedAndProject")


def test_only_needed_columns_are_read(spark):
    plan = plan_of(reports.store_stats(t.supermercados(spark, SF_DIR), t.precos(spark, SF_DIR)))
    schema = re.search(r"ReadSchema: (struct<[^>]*l_suppkey[^>]*>)", plan).group(1)
    assert "l_orderkey" not in schema and "l_shipdate" not in schema


def test_validity_reaches_the_scan(spark, tmp_path):
    t.precos(spark, SF_DIR).write.parquet(str(tmp_path / "precos"))
    stored = spark.read.parquet(str(tmp_path / "precos"))
    plan = plan_of(
        reports.best_prices(t.produtos(spark, SF_DIR), stored, t.supermercados(spark, SF_DIR), t.AS_OF)
    )
    assert "GreaterThanOrEqual(validade_fim,2001-06-01)" in plan


def test_top_names_are_cut_before_the_shuffle(spark):
    plan = plan_of(reports.unmapped_categories(t.produtos(spark, SF_DIR)))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


@pytest.fixture
def split_hot_keys(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield prepare(spark)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_product_is_split(spark, split_hot_keys):
    """One product holds half of the prices: its partition is read by several tasks."""
    facts = spark.range(0, 200_000, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") + 2).alias("produto_id"),
        F.uuid().alias("descricao_adicional"),
    )
    replacements = spark.range(1, 2000).select(F.col("id").alias("produto_id"), (F.col("id") + 1).alias("novo_id"))
    moved = duplicates.move_prices(facts, replacements)
    rows = moved.groupBy((F.col("produto_id") == 2).alias("quente")).agg(
        F.count("*").alias("count"), F.max("descricao_adicional")
    )
    assert {r.quente: r["count"] for r in rows.collect()} == {True: 100_000, False: 100_000}
    assert "skew=true" in plan_of(rows)


def test_hot_name_is_split_in_lookup(spark, split_hot_keys):
    requests = spark.range(0, 200_000, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 2 == 0, "Arroz").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("nome"),
        F.uuid().alias("resto"),
    )
    table = dimensions.with_normalized_name(
        spark.range(1, 3000).select(
            "id",
            F.when(F.col("id") % 3 == 0, "arroz").otherwise(F.concat(F.lit("P"), F.col("id").cast("string"))).alias("nome"),
            F.lit("m").alias("marca"),
            F.lit("c").alias("categoria"),
            F.lit(1).alias("categoria_id"),
            F.lit(t.NOW).cast("timestamp_ntz").alias("created_at"),
        )
    )
    found = dimensions.lookup_products(requests, table).groupBy("produto_id").agg(
        F.count("*").alias("count"), F.max("resto")
    )
    assert {r.produto_id: r["count"] for r in found.collect()}[2997] == 100_000
    assert "skew=true" in plan_of(found)


def test_hot_name_is_split_in_merge(spark, split_hot_keys):
    table = dimensions.with_normalized_name(
        spark.range(0, 200_000, numPartitions=8).select(
            "id",
            F.when(F.col("id") % 2 == 0, "Arroz").otherwise(F.concat(F.lit("p"), (F.col("id") / 4).cast("int").cast("string"))).alias("nome"),
            F.uuid().alias("categoria"),
            F.uuid().alias("marca"),
        )
    )
    links = duplicates.duplicate_links(table, ordered=False).groupBy("produto1_id").agg(
        F.count("*").alias("n"), F.max("produto2_marca"), F.max("produto2_categoria"), F.max("produto2_id")
    )
    assert {r.produto1_id: r.n for r in links.collect()}[0] == 99_999
    assert "skew=true" in plan_of(links)


def test_store_default_makes_the_answers_once(spark):
    assert plan_of(QUERIES["store_default"](spark, SF_DIR)).count("lineitem.parquet") == 1


def test_lines_go_to_their_order_as_columns(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(t.respostas(spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(l_orderkey", plan)]
    assert len(shuffles) == 1 and "StructsToJson" in plan[: shuffles[0]]
    assert "StructsToJson" not in plan[shuffles[0] :]  # below: on the way to the order


def test_waiting_answer_files_grow_with_the_tasks(spark, monkeypatch):
    class Taken(Exception):
        pass

    def take(spark, path, *_, files_per_batch):
        raise Taken(len(spark.read.parquet(path).inputFiles()), files_per_batch)

    monkeypatch.setattr(registry, "start_ingest", take)
    for partitions, coalesced, files in (("12", "false", 12), ("1", "true", 4)):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            with pytest.raises(Taken) as taken:
                QUERIES["ingest_incremental"](spark, SF_DIR)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert taken.value.args == (files, files // 2)
