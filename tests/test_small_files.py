import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.operators import small_files
from siltstone.sources.parquet_blocks import BlockCopyError, concat_files

ENTRY = "entry_id bigint, path string, size_bytes bigint, row_count bigint, bucket string, directory string"
D = "/data/db/t/date=2024-01-01/hour=07"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ENTRY)  # further columns with names the operator uses


def manifests(spark, drops=()):
    return spark.createDataFrame([(1, list(drops)), (2, None)], "manifest_id bigint, drop_queue array<string>")


@pytest.mark.parametrize(
    "spelling",
    [f"{D}/a.1.parquet", f" {D}/a.1.parquet\t", f"file://{D}/a.1.parquet", "db/t/date=2024-01-01/hour=07/a.1.parquet", D.replace("=", "%3D") + "/a.1.parquet", D.replace("/date", "//date") + "/a.1.parquet",
     D.replace("/hour", "/./hour") + "/a.1.parquet", D.replace("/date", "/tmp/../date") + "/a.1.parquet", f"FILE:{D}/x/../y/.././a.1.parquet"],
)
def test_one_path_for_all_spellings(spark, spelling):
    assert spark.createDataFrame([(spelling.strip(" "),)], "p string").select(small_files.canonical_path(F.btrim(F.col("p"), F.lit(" \t")))).first()[0] == f"{D}/a.1.parquet"


def test_odd_paths(spark):
    got = spark.createDataFrame([(None,), ("",), ("/",), ("/../a",), ("/a+b%20c",), ("/100%",)], "p string").select(small_files.canonical_path(F.col("p"))).collect()
    assert [r[0] for r in got] == [None, "/data/", "/", "/a", "/a+b c", "/100%"]


def test_found_rules(spark):
    small = [(i, f"{D}/{i}.1.parquet", 100, 10) for i in range(1, 6)]
    rows = [
        *small,
        (40, f"{D}/1.1.parquet", None, None),  # listed again
        (0, f"file://{D}/2.1.parquet", 100, None),  # listed again, lower id, other spelling
        (50, f"{D}/big.1.parquet", small_files.SMALL_BYTES, 1),
        (51, f"{D}/unknown.1.parquet", None, 5),
        (52, f"{D}/negative.1.parquet", -1, 5),
        (53, None, 5, 5),
        (54, f"{D}/dropped.1.parquet", 5, 5),
        *[(60 + i, f"/data/db/u/date=2024-01-01/hour=07/{i}.1.parquet", 1, 1) for i in range(4)],  # too few
    ]
    plan = small_files.plan_outputs(entries(spark, rows), manifests(spark, [f" {D}/dropped.1.parquet", None]))
    assert sorted(r.entry_id for r in plan.collect()) == [0, 1, 3, 4, 5]


def test_empty(spark):
    assert small_files.plan_outputs(entries(spark, []), manifests(spark)).count() == 0


def test_every_file_once_and_outputs_well_sized(spark):
    random.seed(5)
    rows = [(i, f"/data/db/{'hot' if i % 3 else 'cold'}/date=2024-01-01/hour=0{i % 2}/{i}.1.parquet", random.randrange(0, 1000), i) for i in range(2000)]
    rows += random.sample(rows, 300)
    plan = small_files.plan_outputs(entries(spark, rows), manifests(spark), small_bytes=1000, target_bytes=20_000).toPandas()
    assert sorted(plan.entry_id) == list(range(2000))
    sizes = plan.groupby("output_path").size_bytes.sum()
    assert sizes.max() < 21_000
    for d, part in plan.groupby("directory"):
        assert part.output_path.nunique() <= part.size_bytes.sum() // 20_000 + 1
        assert part.output_path.str.startswith(d + "/").all()


def test_outputs_have_few_inputs_too(spark):
    rows = [(i, 1, f"/data/d/t/date=2024-01-01/hour=00/{i}.1.parquet", i % 3, 1) for i in range(1000)]
    index = spark.createDataFrame(rows, "entry_id bigint, manifest_id bigint, path string, size_bytes bigint, row_count bigint")
    plan = small_files.plan_outputs(index, manifests(spark), max_inputs=50).toPandas()
    assert sorted(plan.entry_id) == list(range(1000)) and plan.groupby("output_path").size().max() <= 51 and plan.output_path.nunique() <= 21


def write(path, table, **options):
    pq.write_table(table, path, **options)
    return str(path)


def sample(seed, n):
    rng = random.Random(seed)
    return pa.table(
        {
            "i": pa.array([rng.randrange(10) if rng.random() > 0.1 else None for _ in range(n)], pa.int64()),
            "s": pa.array([rng.choice(["a", "bb", "", None, "é" * 50]) for _ in range(n)], pa.string()),
            "d": pa.array([rng.random() for _ in range(n)], pa.float64()),
            "l": pa.array([[{"x": rng.randrange(5), "y": None}] * rng.randrange(3) for _ in range(n)], pa.list_(pa.struct([("x", pa.int32()), ("y", pa.string())]))),
            "b": pa.array([rng.random() > 0.5 for _ in range(n)], pa.bool_()),
        }
    )


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd"])
def test_blocks_round_trip(tmp_path, codec):
    tables = [sample(k, n) for k, n in enumerate((1000, 1, 0, 3777))]
    files = [write(tmp_path / f"{k}.parquet", t, compression=codec, row_group_size=500, use_dictionary=k % 2 == 0, write_page_index=k == 3) for k, t in enumerate(tables)]
    out = str(tmp_path / "new" / "out.parquet")
    [(name, inputs, groups, rows, size)] = concat_files([(f, t.num_rows) for f, t in zip(files, tables, strict=True)], out)
    assert (name, inputs, rows, size) == (out, 4, 4778, os.path.getsize(out))
    assert pq.read_table(out).equals(pa.concat_tables(tables))
    meta = pq.read_metadata(out)
    assert (meta.num_rows, meta.num_row_groups) == (4778, groups)
    assert groups == sum(pq.read_metadata(f).num_row_groups for f in files)
    assert pq.read_table(out, columns=["i"], filters=[("i", "=", 3)]).num_rows == sum(t.column("i").to_pylist().count(3) for t in tables)


def test_blocks_of_unlike_schema_stay_apart(tmp_path):
    a, b = pa.table({"x": [1, 2]}), pa.table({"x": ["1"]})
    out = str(tmp_path / "o.parquet")
    made = concat_files([(write(tmp_path / "a.parquet", a), 2), (write(tmp_path / "b.parquet", b), 1), (write(tmp_path / "c.parquet", a), 2)], out)
    assert [m[:2] for m in made] == [(out, 2), (out.replace(".parquet", "-s1.parquet"), 1)]
    assert pq.read_table(out).num_rows == 4


def test_blocks_are_validated(tmp_path):
    f = write(tmp_path / "a.parquet", pa.table({"x": [1, 2]}))
    with pytest.raises(BlockCopyError, match="3 in the plan"):
        concat_files([(f, 3)], str(tmp_path / "o.parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nothing here")
    with pytest.raises(BlockCopyError):
        concat_files([(str(tmp_path / "bad.parquet"), None)], str(tmp_path / "o.parquet"))
    with pytest.raises(BlockCopyError, match="missing"):
        concat_files([(str(tmp_path / "none.parquet"), None)], str(tmp_path / "o.parquet"))


def test_spark_reads_what_was_joined(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as string) s").repartition(20).write.parquet(str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("row_count"))
    plan = files.withColumn("output_path", F.concat(F.lit(f"{tmp_path}/out/m"), F.pmod(F.hash("path"), F.lit(3)).cast("string"), F.lit(".parquet")))
    report = small_files.consolidate(plan).collect()
    assert sum(r.rows for r in report) == 1000 and sum(r.inputs for r in report) == files.count()
    shutil.rmtree(tmp_path / "in")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1000))
