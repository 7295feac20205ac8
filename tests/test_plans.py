"""Pipelines, sources and sinks."""

import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import millrace.operators  # noqa: F401
from millrace.plans.pipeline import Pipeline, run_operator


def write(tmp_path, rows):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_yaml(spark, tmp_path):
    path = write(tmp_path, [{"content": "a 1\nb"}, {"content": "c"}])
    (tmp_path / "p.yaml").write_text(f"""
last:
  op_name: length_filter
  input_df: lines
  output_df: out
  field: content
  max_length: 1
  select: [content]
  renames: {{content: text}}
  show: false
read:
  op_name: regular_path_reader
  input_path: {path}
  format: json
  output_df: docs
lines:
  op_name: filter_line_by_regex_mapper
  input_df: docs
  output_df: lines
  field: content
  output_field: content
  regex: '\\d+'
  partitions: 2
""")
    pipeline = Pipeline.from_yaml(str(tmp_path / "p.yaml"))
    assert [n.name for n in pipeline.nodes()] == ["read", "lines", "last"]
    assert sorted(r.text for r in Pipeline({**{k: pipeline.config[k] for k in ("read", "lines")}, "last": pipeline.config["last"]}).run(spark).collect()) == ["b", "c"]


def test_views_and_sql(spark, tmp_path):
    path = write(tmp_path, [{"a": 1}, {"a": 2}])
    got = Pipeline.from_list([
        {"op_name": "regular_path_reader", "input_path": path, "format": "json", "output_df": "in", "temp_view_name": "v_in"},
        {"op_name": "spark_sql_executor", "input_df": "in", "output_df": "out", "sql_query": "SELECT sum(a) AS s FROM v_in"},
    ]).run(spark)
    assert got.first().s == 3
    got = Pipeline.from_list([
        {"op_name": "regular_path_reader", "input_path": path, "format": "json", "output_df": "in"},
        {"op_name": "spark_sql_executor", "output_df": "out", "sql_query": "SELECT max(a) AS s FROM {in}"},
    ]).run(spark)
    assert got.first().s == 2


def test_refusals():
    read = {"op_name": "regular_path_reader", "input_path": "x", "format": "json", "output_df": "in"}
    step = {"op_name": "text_length_mapper", "input_df": "in", "output_df": "out", "field": "t", "output_field": "n"}
    for steps in (
        [read, {**step, "misspelt": 1}],
        [read, {**step, "op_name": "no_such"}],
        [read, {**step, "input_df": "nowhere"}],
        [read, {**step, "output_df": "in"}],
        [read, {**step, "select": ["a"], "drop": ["b"]}],
        [read, {**step, "input_df": None}],
        [{**read, "temp_view_name": "v"}, {**step, "temp_view_name": "v"}],
        [read, {"op_name": "length_filter", "input_df": "in", "output_df": "o", "field": "t", "mode": "other"}],
        [{**step, "input_df": "b", "output_df": "a"}, {**step, "input_df": "a", "output_df": "b"}],
    ):
        with pytest.raises(ValueError):
            Pipeline.from_list(steps).nodes()


def test_own_operators(spark, tmp_path):
    path = write(tmp_path, [{"a": "x"}])

    def shout(df, col, times: int = 1):
        return F.concat(F.upper(col), F.lit("!" * times))

    steps = [
        {"op_name": "regular_path_reader", "input_path": path, "format": "json", "output_df": "in"},
        {"op_name": "shout", "input_df": "in", "output_df": "out", "field": "a", "output_field": "b", "times": 2},
    ]
    for _ in range(2):
        assert Pipeline.from_list(steps, {"shout": ("map", shout)}).run(spark).first().b == "X!!"
    with pytest.raises(ValueError):
        Pipeline.from_list(steps, {"explode": ("map", shout)}).nodes()


def test_common_parameters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    got = run_operator("text_length_mapper", df, field="t", output_field="n", drop=["t"], limit=1, cache="memory", count=True, show={"truncate": False})
    assert got.columns == ["i", "n"] and got.count() == 1
    got.unpersist()
    with pytest.raises(ValueError):
        run_operator("text_length_mapper", df, field="gone", output_field="n")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string")
    out = run_operator("path_writer", df, path=str(tmp_path / "o"), format="csv", mode="overwrite")
    assert out.count() == 2
    (tmp_path / "c.csv").write_text("text\nhello\n")
    read = lambda **p: run_operator("regular_path_reader", spark=spark, **p).collect()
    assert [r.text for r in read(input_path=str(tmp_path / "c.csv"), format="csv")] == ["hello"]
    assert len(read(input_path=str(tmp_path / "c.csv"), format="csv", options={"header": False})) == 2
    assert [r.value for r in read(input_path=str(tmp_path / "c.csv"), format="text")] == ["text", "hello"]
    assert len(read(input_path=str(tmp_path / "c.csv"), format="binaryFile")) == 1
    whole = run_operator("whole_text_file_reader", spark=spark, input_path=str(tmp_path / "c.csv")).first()
    assert whole.text == "text\nhello\n" and whole.file_path.endswith("c.csv")
    with pytest.raises(ValueError):
        read(input_path="x", format="xls")


def record(kind, url, body, content_type="text/plain"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    data = record("warcinfo", "", b"x") + record("response", "http://a/", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>WARC/1.0 inside</p>", "application/http; msgtype=response")
    data += record("conversion", "http://b/", "é text".encode()) + record("conversion", "http://c/", b"\xff\xfe")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    for name in ("a.warc", "b.warc.gz"):
        read = lambda *types: sorted(map(tuple, run_operator("warc_wet_reader", spark=spark, input_path=str(tmp_path / name), types=list(types)).collect()))  # noqa: B023, E731
        assert read("response") == [("http://a/", "<p>WARC/1.0 inside</p>")]
        assert read("response", "conversion") == [("http://a/", "<p>WARC/1.0 inside</p>"), ("http://b/", "é text")]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "id long, value string, dt string")
    new = spark.createDataFrame([(3, "c", "d2")], "id long, value string, dt string")
    for name, more in (("ext_t", {"is_external": True, "external_location": str(tmp_path / "ext")}), ("own_t", {})):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        write = lambda df, mode, **p: run_operator("hive_table_writer", df, table_name=name, save_mode=mode, partition_by=["dt"], **more, **p)  # noqa: B023, E731
        write(rows, "overwrite")
        write(new, "overwrite", dynamic_partition_overwrite=True)
        read = run_operator("hive_reader", spark=spark, table_name=name)
        assert sorted(r.id for r in read.collect()) == [1, 3]
        write(rows, "append")
        assert spark.table(name).count() == 4
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
        spark.sql(f"DROP TABLE {name}")
    for bad in ({"is_external": True}, {"partition_by": ["no"]}):
        with pytest.raises(ValueError):
            run_operator("hive_table_writer", rows, table_name="x_t", save_mode="append", **bad)


def test_row_local_operators_stream(spark, tmp_path):
    from millrace.streaming import dedup_stream, over_stream

    source = tmp_path / "s"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("bb", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02")], "t string, ts string").selectExpr("t", "to_timestamp(ts) ts").write.parquet(str(source))
    stream = spark.readStream.schema("t string, ts timestamp").parquet(str(source))
    out = over_stream(stream, [{"op_name": "text_length_mapper", "field": "t", "output_field": "n"}, {"op_name": "length_filter", "field": "t", "min_length": 1}])
    assert out.isStreaming
    q = dedup_stream(out, "t", "ts", "1 hour").writeStream.format("memory").queryName("millrace_s").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.t, r.n) for r in spark.table("millrace_s").collect()) == [("a", 1), ("bb", 2)]
    with pytest.raises(ValueError):
        over_stream(stream, [{"op_name": "exact_deduplicator", "field": "t"}])


def test_durable_tables(spark, monkeypatch):
    import millrace.plans.durable as d

    kept = d.durable(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    assert kept.count() == 3 and spark.conf.get(d.CLEANUP) == "false"
    path = kept.durable_path
    d.discard(kept)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "yarn"
            applicationId = "a"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(ValueError):
        d.shared_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        d.shared_dir(Elsewhere)


def test_broadcasts_are_bounded_in_bytes(spark):
    from millrace.plans.durable import broadcast_if_small

    hinted = lambda df, *bounds: "ResolvedHint" in broadcast_if_small(df, *bounds)._jdf.queryExecution().analyzed().toString()
    ids, texts = spark.range(1000), spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.array(F.lit("a")).alias("a"))
    assert hinted(ids, 1000) and not hinted(ids, 999) and not hinted(ids, 1000, 7999)
    assert hinted(texts, 1000, 1_200_000) and not hinted(texts, 1000, 1_000_000) and hinted(ids.limit(0), 1)


def test_spread(spark, tmp_path):
    """A file of one row group is dealt to all cores, with selections and filters still at the scan; larger inputs and those of many files stay."""
    from millrace.plans.spread import spread

    spark.range(1000).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(9).write.parquet(f"{tmp_path}/many")
    one = run_operator("regular_path_reader", spark=spark, input_path=f"{tmp_path}/one", format="parquet", spread=True)
    assert one.rdd.getNumPartitions() == 4 and one.count() == 1000
    plan = one.filter("b > 10").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan and "GreaterThan(b,10)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan
    table = spark.read.parquet(f"{tmp_path}/one")
    assert spread(table, 10) is table
    table = spark.read.parquet(f"{tmp_path}/many")
    assert spread(table) is table
    assert spread(spark.read.parquet(f"{tmp_path}/one").limit(0)).collect() == []
