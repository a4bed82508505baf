"""Files in and out: Arrow conversion, packs, submissions, CSV, contract errors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.operators import contract
from bookflow.schema import ORDER
from bookflow.sources import ingest, sinks


def arrow_file(path, batches):
    fields = [("sample_id", pa.int32()), ("seconds_before_predict", pa.float32()), ("price", pa.float32()),
              ("volume", pa.int32()), ("side", pa.int8()), ("order_action", pa.int8())]
    schema = pa.schema(fields)
    n = 0
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, schema) as out:
        for size in batches:
            ids = range(n, n + size)
            cols = [[i // 3 for i in ids], [float(59 - i % 60) for i in ids], [1.0 + i for i in ids], list(ids), [i % 2 for i in ids], [0] * size]
            out.write_batch(pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=schema))
            n += size
    return str(path)


def test_arrow_files_keep_row_order(spark, tmp_path):
    files = [arrow_file(tmp_path / "a.feather", [10, 7]), arrow_file(tmp_path / "b.feather", [5])]
    df = ingest.convert_arrow_files(spark, files, ORDER, rows_per_slice=4)
    rows = df.orderBy("event_seq").collect()
    assert [r.volume for r in rows] == [*range(17), *range(5)]
    assert df.schema["price"].dataType.simpleString() == "float" and df.schema["side"].dataType.simpleString() == "tinyint"


@pytest.mark.parametrize("codec", [None, "lz4", "zstd"])
def test_one_huge_batch_is_read_by_ranges(spark, tmp_path, codec):
    """Several tasks share one record batch; columns with nulls, columns that are not asked for and both codecs."""
    n, path = 100_003, str(tmp_path / "one.feather")
    rng = np.random.default_rng(1)
    x = pa.array(rng.normal(size=n), mask=rng.random(n) < 0.1)
    table = pa.record_batch({"sample_id": pa.array(np.arange(n) // 7, pa.int32()), "note": pa.array(["a" * (i % 5) for i in range(n)]), "x": x, "same": pa.array(np.zeros(n), pa.float32())})
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(table)
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("sample_id", T.LongType()), T.StructField("same", T.FloatType())])
    df = ingest.convert_arrow_files(spark, [path, path], schema, rows_per_slice=9_001)
    assert df.rdd.getNumPartitions() == 24
    got = df.where("event_seq < 1000000").orderBy("event_seq").toArrow()
    assert got["event_seq"].to_pylist() == list(range(n)) and got["sample_id"].to_pylist() == [i // 7 for i in range(n)]
    assert got["x"].to_pylist() == x.to_pylist() and set(got["same"].to_pylist()) == {0.0}
    assert df.where("event_seq >= 1000000").agg(F.min("event_seq"), F.max("event_seq"), F.count("x")).first() == (1 << 40, (1 << 40) + n - 1, n - x.null_count)


def test_a_task_holds_no_column(tmp_path):
    """20 million rows in one packed batch: a range of a million takes far less than one column (160 MB)."""
    import subprocess
    import sys

    path, n = str(tmp_path / "large.feather"), 20_000_000
    table = pa.record_batch({"sample_id": pa.array(np.arange(n) // 100), "price": pa.array(np.arange(n) % 1000 / 8.0)})
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(table)
    code = f"""
import resource
from bookflow.sources.arrow_source import rows_of
list(rows_of({path!r}, 0, 0, 8, ["price"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(len(c["price"]) for _, c in rows_of({path!r}, 0, {n} - 1_000_003, {n}, ["price", "sample_id"]) if c["sample_id"][0].as_py() >= 0)
print(rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    rows, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert rows == 1_000_003 and more < 100_000


def test_text_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "t.feather")
    table = pa.record_batch({"note": pa.array(["a"])})
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_batch(table)
    for name, what in (("note", "no number"), ("gone", "no columns")):
        with pytest.raises(Exception, match=what):
            ingest.convert_arrow_files(spark, [path], T.StructType([T.StructField(name, T.DoubleType())])).collect()


def test_pack_round_trip_and_tampering(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("int").alias("sample_id"), (F.col("id") * 0.5).alias("x"))
    sinks.write_pack(df, str(tmp_path / "pack"))
    assert sinks.read_pack(spark, str(tmp_path / "pack")).count() == 20
    df.limit(3).write.mode("append").parquet(str(tmp_path / "pack" / "data"))
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_pack(spark, str(tmp_path / "pack"))
    with pytest.raises(ValueError, match="not a valid pack"):
        sinks.write_pack(df.union(df.limit(1)), str(tmp_path / "twice"))


def test_submission_follows_the_template(spark, tmp_path):
    template = spark.createDataFrame([(2, 0), (0, 1), (1, 2)], "sample_id int, position int")
    pred = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5)], "sample_id int, target double")
    sinks.write_submission(sinks.submission(template, pred), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect() if not r.value.startswith("sample")]
    assert sorted(lines) == ["0,0.5", "1,1.5", "2,2.5"]
    for bad in (pred.limit(2), pred.union(pred.limit(1)), pred.withColumn("target", F.lit(float("nan")))):
        with pytest.raises(Exception, match="do not fit"):
            sinks.submission(template, bad).collect()


def test_feature_csv_keeps_numbers(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    spark.createDataFrame([(0, 1.5, "x", 3), (1, 2.5, "y", 4)], "sample_id int, a double, tag string, month int").write.option(
        "header", True
    ).csv(path)
    df, names = ingest.read_feature_csv(spark, path)
    assert names == ["a"] and df.columns == ["sample_id", "a"]
    with pytest.raises(ValueError):
        ingest.same_columns(["a"], ["b"])


def test_broken_contract_raises(spark):
    ok = spark.createDataFrame([(0, 5.0, 1.0, 0)], "sample_id int, seconds_before_predict double, price double, side int")
    assert contract.checked(ok, 60).count() == 1
    for bad in (ok.withColumn("side", F.lit(2)), ok.withColumn("seconds_before_predict", F.lit(61.0)), ok.withColumn("price", F.lit(float("nan")))):
        with pytest.raises(Exception, match="contract broken"):
            contract.checked(bad, 60).collect()


def test_slices_may_not_overlap(spark):
    a = spark.createDataFrame([(0, 1.0)], "sample_id int, x double")
    with pytest.raises(Exception, match="overlap"):
        contract.union_disjoint([a, a]).collect()


def test_ingest_counts_every_rule_in_one_pass(spark, tmp_path):
    """Each broken rule fails; good rows are written and their counts equal a count of their own."""
    n = 50
    good = {"sample_id": [i // 5 for i in range(n)], "seconds_before_predict": [float(59 - i % 60) for i in range(n)], "price": [1.0 + i for i in range(n)],
            "volume": list(range(n)), "side": [i % 2 for i in range(n)], "order_action": [0] * n}
    kinds = [pa.int32(), pa.float32(), pa.float32(), pa.int32(), pa.int8(), pa.int8()]

    def ingested(name, **broken):
        columns = {k: [broken[k]] + v[1:] if k in broken else v for k, v in good.items()}
        table, path = pa.record_batch([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns)), str(tmp_path / f"{name}.arrow")
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_batch(table)
        return ingest.ingest_arrow(spark, [path], ORDER, str(tmp_path / name), 60, ("side", "order_action"), rows_per_slice=13)

    counts = ingested("good")
    assert counts == contract.contract_counts(spark.read.parquet(str(tmp_path / "good/data")), 60, ("side", "order_action")).first().asDict()
    assert counts["rows"] == n and not contract.broken(counts)
    for k, (rule, broken) in enumerate({"bad_id": {"sample_id": -1}, "outside_span": {"seconds_before_predict": 61.0}, "bad_price": {"price": float("nan")}, "bad_volume": {"volume": None}, "code_side": {"side": 2}, "code_order_action": {"order_action": 3}}.items()):
        with pytest.raises(ValueError, match=f"{rule}': 1"):
            ingested(f"bad{k}", **broken)


def test_probes_merge(spark):
    df = spark.range(20000).select((F.col("id") % 5000).cast("int").alias("sample_id"), (F.col("id") * 0.5).alias("x"))
    probes = contract.probe(df.where("sample_id < 2500")).unionByName(contract.probe(df.where("sample_id >= 2500")))
    r = contract.probed(contract.merged_probes(probes)).first()
    assert r.rows == 20000 and r.types == "sample_id:int,x:double" and abs(r.keys - 5000) < 250
    assert all(abs(q - p * 10000) < 300 for q, p in zip(r.x, (0.25, 0.5, 0.75)))
    with pytest.raises(Exception, match="differ in their types"):
        contract.merged_probes(probes.union(contract.probe(df.withColumn("x", F.col("x").cast("float"))))).collect()
