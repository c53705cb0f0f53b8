"""Lines by byte ranges, ordered parts with a manifest, keyed sinks, table functions, and what counts over very many rows."""

from __future__ import annotations

import json
import random
import re
import subprocess
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trickstat.functions import scoring
from trickstat.operators import keys, play, rates
from trickstat.sources import lines, parts, records
from trickstat.streaming import incremental


def lines_in(data):
    got = data.decode("utf-8", "replace").removeprefix("﻿").split("\n")
    return [x.removesuffix("\r") for x in (got[:-1] if got[-1] == "" else got)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_ranges_own_each_line_once(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(lines, "READ_BYTES", piece)
    rnd = random.Random(piece)
    for data in (b"", b"a", b"\n", b"\n\n", b"\xef\xbb\xbfa\r\nb\r\n\r\n", b"ab\ncd", *("".join(rnd.choice("ab,\r\n\né") for _ in range(rnd.randint(1, 90))).encode() for _ in range(25))):
        path = tmp_path / "f"
        path.write_bytes(data)
        for size in (1, 2, 3, 10, 1000):
            reader = lines.LineReader(str(path), size, False)
            got = [line for r in reader.partitions() for b in reader.read(r) for line in b.column("line").to_pylist()]
            assert got == lines_in(data)
            counts = [c for r in lines.LineReader(str(path), size, True).partitions() for b in lines.LineReader(str(path), size, True).read(r) for c in b.to_pylist()]
            assert sum(c["lines"] for c in counts) == len(got) and sum(c["filled"] for c in counts) == sum(map(bool, got))


def test_rows_of_a_large_file_have_their_position(spark, tmp_path):
    rnd = random.Random(1)
    body = [f"{i},{'y' * rnd.randint(0, 200)}" if i % 7 else "" for i in range(60_000)]
    (tmp_path / "a.csv").write_text("\n".join(["no header yet", "Id,Text", *body]))
    (tmp_path / "b.csv").write_text("Id,Text\nz,1\n")
    (tmp_path / "c.csv").write_text("nothing to part\n")
    (tmp_path / "_hidden").write_text("h,h\n1,2\n")
    assert (tmp_path / "a.csv").stat().st_size > 5_000_000
    got = records.read_records(spark, str(tmp_path), range_bytes=100_000)
    want = [x.split(",")[0] for x in body if x] + ["z"]
    assert {r.row_id: r.Id for r in got.select("row_id", "Id").collect()} == dict(enumerate(want, 1))
    one = records.read_records(spark, f"{tmp_path}/b.csv,{tmp_path}/c.csv", one_table=True)
    assert [tuple(r) for r in one.orderBy("row_id").collect()] == [(1, "z", "1"), (2, "nothing to part", None)]
    with pytest.raises(ValueError, match="comma"):
        records.read_records(spark, str(tmp_path / "c.csv"))


def test_parts_are_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5000).select(F.col("id"), F.concat(F.lit("é"), F.col("id")).alias("line")).repartition(7)
    parts.write_parts(df, ["id"], "line", path, header="head")
    names = sorted(p.name for p in Path(path).iterdir() if not p.name.startswith("."))
    said = json.loads((Path(path) / parts.MANIFEST).read_text())
    assert names == [parts.MANIFEST, *(p["name"] for p in said["parts"])] and len(names) > 2 and said["rows"] == 5001
    whole = "".join((Path(path) / n).read_text() for n in names[1:])
    assert whole == "head\n" + "".join(f"é{i}\n" for i in range(5000))
    got = [r.line for r in parts.read_parts(spark, path).orderBy("part", "n").collect()]
    assert got == ["head", *(f"é{i}" for i in range(5000))]
    with pytest.raises(Exception, match="mode overwrite"):
        parts.write_parts(df, ["id"], "line", path)
    parts.write_parts(df.where("id < 3"), ["id"], "line", path, mode="overwrite")
    assert [r.line for r in parts.read_parts(spark, path).orderBy("part", "n").collect()] == ["é0", "é1", "é2"]
    parts.write_parts(df.limit(0), ["id"], "line", str(tmp_path / "none"))
    assert parts.read_parts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="one column"):
        df.write.format(parts.FORMAT).mode("append").save(str(tmp_path / "two"))


FAILING = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from trickstat.sources import parts
path, always = sys.argv[1], sys.argv[2] == "always"
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate()

@F.udf("string")
def fragile(i):
    from pyspark import TaskContext
    if i == 1700 and (always or TaskContext.get().attemptNumber() == 0):
        raise RuntimeError("lost")
    return f"row {i}"

df = spark.range(3000).repartitionByRange(3, "id").sortWithinPartitions("id").select(fragile("id").alias("line"))
spark.dataSource.register(parts.Parts)
df.write.format(parts.FORMAT).mode("append").save(path)
"""


@pytest.mark.parametrize("how", ["once", "always"])
def test_parts_of_failed_attempts_are_not_seen(spark, tmp_path, how):
    """A task that fails once writes its part once; a job that fails leaves nothing."""
    path = tmp_path / "out"
    run = subprocess.run([sys.executable, "-c", FAILING, str(path), how], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    names = sorted(p.name for p in path.iterdir() if not p.name.startswith("."))
    if how == "always":
        assert run.returncode and names == []
        with pytest.raises(Exception, match="manifest"):
            parts.read_parts(spark, str(path)).count()
    else:
        assert not run.returncode, run.stderr[-2000:]
        assert names == [parts.MANIFEST, "part-000000", "part-000001", "part-000002"]
        assert [r.line for r in parts.read_parts(spark, str(path)).orderBy("part", "n").collect()] == [f"row {i}" for i in range(3000)]


def test_lookup_is_read_back(spark, tmp_path):
    lin = "pn|s1,w1,n1,e1|st||md|3SAKQH2,H34,D5|ah|Board 7|sv|b|mb|1C|an|one, two x|mb|p!|pc|SA|pc|H3|pc|D5|pc|C2|pc|SK|mc|9|"
    df = spark.createDataFrame([(2, "u2", None), (10, "u10", lin), (3, None, ""), (4, "u4", "no record")], "n long, u string, r string")
    table = records.lookup_table(df, "n", "u", "r")
    assert tuple(table.columns) == records.LOOKUP and len(table.columns) == 15
    records.write_lookup(table, str(tmp_path / "l"))
    got = records.read_records(spark, str(tmp_path / "l"), one_table=True).orderBy("row_id").collect()
    assert [(r.Board_ID, r.TinyURL, r.Dealer, r.LIN_URL) for r in got] == [("2", "u2", None, None), ("3", None, None, None), ("4", "u4", None, None), ("10", "u10", "N", lin)]
    assert (got[3].Auction, got[3].Explanations, got[3].Cardplay, got[3].Claim) == ("1C-p!", "1C=one,+two+x", "SA H3 D5 C2|SK", "9")


def test_a_batch_that_runs_twice(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    now = lambda sink: sorted(map(tuple, incremental.current_rows(spark, sink, ["k"]).select("k", "v").collect()))
    every = lambda sink: spark.read.parquet(sink).count()
    keep, replace = str(tmp_path / "keep"), str(tmp_path / "replace")
    seen = []
    take = incremental.keyed_sink(keep, ["k"], lambda df: seen.append(df.count()) or df)
    for batch, i in ((rows((1, "a"), (2, "b"), (2, "c")), 0), (rows((2, "changed"), (3, "d")), 1), (rows((2, "changed"), (3, "d")), 1), (rows((1, "a"), (2, "b"), (2, "c")), 0)):
        take(batch, i)
    assert now(keep) == [(1, "a"), (2, "b"), (3, "d")] and every(keep) == 3 and seen[1:3] == [1, 1]
    take = incremental.keyed_sink(replace, ["k"], changed="replace")
    for _ in range(2):
        take(rows((1, "a"), (2, "b")), 0)
        take(rows((2, "changed"), (3, "d")), 1)
    assert now(replace) == [(1, "a"), (2, "changed"), (3, "d")] and every(replace) == 4
    with pytest.raises(ValueError):
        incremental.keyed_sink(keep, ["k"], changed="other")


def test_streams_by_key(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k int, v int"
    tried = spark.sparkContext.accumulator(0)

    def inverse(row):
        tried.add(1)
        return {"inv": 10 // row["v"]}

    for part in ([(1, 5), (2, 0)], [(1, 5), (2, 2), (3, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.score_stream(spark, spark.createDataFrame([], schema).schema, source, sink, progress, ["k"], inverse, "inv int")
    got = incremental.current_rows(spark, sink, ["k"])
    assert sorted((r.k, r.inv, r.status) for r in got.collect()) == [(1, 2, "ok"), (2, 5, "ok"), (3, 10, "ok")] and tried.value == 4
    new = incremental.ingest_new(spark.createDataFrame([(1,), (7,)], "k int"), got, "k")
    assert [r.k for r in new.collect()] == [7]


def test_scorer_as_table_function(spark):
    def pieces(row):
        if row["v"] < 0:
            yield {"i": 0, "x": 1.0}
            raise ValueError("negative")
        for i in range(row["v"]):
            yield {"i": i, "x": i / 2}

    scoring.scorer_table(spark, "pieces", pieces, "i int, x double")
    df = spark.createDataFrame([(1, 2, "a"), (2, 0, "b"), (3, -1, None)], "k int, v int, s string")
    got = scoring.scored_by(df, "pieces", ["k", "s"])
    assert got.columns == ["k", "s", "i", "x", "status"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0, 0.0, "ok"), (1, "a", 1, 0.5, "ok"), (3, None, None, None, "ERROR: ValueError: negative")]
    assert scoring.scored_by(df, "pieces").columns == ["k", "v", "s", "i", "x", "status"]
    for keep in (["absent"], ["k", "i"]):
        with pytest.raises(AnalysisException):
            scoring.scored_by(df.withColumn("i", F.lit(1)), "pieces", keep).collect()


def test_sums_before(spark):
    rnd = random.Random(6)
    rows = [(g, o, rnd.randint(0, 9)) for g in ("a", "b") for o in rnd.sample(range(0, 10**6, 7), 90)]
    df = spark.createDataFrame([*rows, ("c", 5, 1)], "g string, o long, n int")
    got = keys.with_sums_before(df, {"n": "before"}, "o", "g", block=8)
    assert {(r.g, r.o): r.before for r in got.collect()} == {(g, o): sum(m for h, p, m in rows if h == g and p < o) for g, o, _ in rows} | {("c", 5): 0}
    assert [r.before for r in keys.with_sums_before(df.where("g = 'a'"), {"n": "before"}, "o").orderBy("o").collect()][0] == 0
    assert keys.with_row_id(spark.range(0), "id").count() == 0


def test_pairs_of_large_groups(spark):
    rnd = random.Random(2)
    groups = {"hot": range(400), "b": rnd.sample(range(400), 30), "c": [1], "d": [2, 3]}
    rows = [(g, e) for g, es in groups.items() for e in es] * 2 + [("b", None), (None, 5), (None, 6)]
    want = Counter(p for es in groups.values() for p in combinations(sorted(es), 2))
    df = spark.createDataFrame(rows, "g string, e int")
    for block in (7, 2000):
        assert {(r.a, r.b): r.n for r in rates.pair_counts(df, "g", "e", block).collect()} == want


def test_pairs_of_large_groups_are_not_shuffled(spark):
    df = spark.createDataFrame([(g, e) for g in "xy" for e in range(50)], "g string, e int")
    got = rates.pair_counts(df, "g", "e", 8)
    assert got.where("n = 2").count() == 1225 == got.count()
    rnd = random.Random(5)
    groups = {g: rnd.sample(range(120), n) for g, n in enumerate((100, 11, 12, 13, 2))}  # some have no members in some blocks
    sparse = spark.createDataFrame([(float("nan") if g == 1 else float(g), e) for g, es in groups.items() for e in es], "g double, e int")
    assert {(r.a, r.b): r.n for r in rates.pair_counts(sparse, "g", "e", 10).collect()} == Counter(p for es in groups.values() for p in combinations(sorted(es), 2))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("MapInArrow") > -1 and "Aggregate" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_members_of_large_groups_are_sent_to_few_blocks(spark):
    df = spark.range(0, 40_000, 1, 4).selectExpr("id % 2 as g", "id div 2 % 400 as e")
    sc = spark.sparkContext
    sc.setJobGroup("blocks", "blocks")
    try:
        got = [tuple(r) for r in rates.pair_counts(df, "g", "e", 2).collect()]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == [(a, b, 2) for a, b in combinations(range(400), 2)]
    stages = {i for j in sc.statusTracker().getJobIdsForGroup("blocks") for i in sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getStageInfo(i)}
    sent = sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteRecords() for i in stages)
    assert 0 < sent < 40_000  # each member to 200 blocks would be 80,000, each row before it is made distinct 40,000 in each of two jobs


@pytest.mark.parametrize("limits", [{"BLOCKS": 3, "EACH": 20}, {"BLOCKS": 1, "MEMBERS": 50}, {"BLOCKS": 2, "HELD": 16}])
def test_pairs_in_any_number_of_blocks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(rates, name, value)
    rnd = random.Random(7)
    groups = {g: rnd.sample(range(150), n) for g, n in enumerate((120, 90, 40, 9, 8, 7, 2, 2, 1))}
    df = spark.createDataFrame([(g, f"e{e}") for g, es in groups.items() for e in es * 3], "g int, e string")
    want = Counter(p for es in groups.values() for p in combinations(sorted(f"e{e}" for e in es), 2))
    for block in (1, 8):
        got = rates.pair_counts(df, "g", "e", block).collect()
        assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)


def test_partitions_of_pairs_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(rates, "EACH", 100)
    df = spark.range(900).selectExpr("id div 3 as g", "id % 50 as e")
    assert rates.pair_counts(df, "g", "e").rdd.getNumPartitions() == 9


def test_partitions_of_groups_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(rates, "EACH", 100)
    df = spark.range(900).selectExpr("if(id < 60, -1, id div 3) as g", "id % 60 as e")
    got = rates.pair_counts(df, "g", "e", 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.where("n > 0").count() == 1770 and re.search(r"hashpartitioning\(_g#\d+L?, 9\)", plan) and not re.search(r"hashpartitioning\(_g#\d+L?, 4\)", plan)


def test_validation(spark):
    rnd = random.Random(8)
    rows = [(i if rnd.random() < 0.98 else None, rnd.choice([None, 1, 2]), rnd.choice([None, -1, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "r int, c int, g int").repartition(5)
    got = rates.validate_levels(df, F.col("r"), F.col("c"), F.col("g")).first()
    ok = [(-1 if r is None else r, c, g) for r, c, g in rows if c is not None and g is not None and g >= 0]
    wrong = sorted(x for x in ok if x[1] != x[2])
    assert (got.matches, got.mismatches, got.not_given, got.overflow) == (len(ok) - len(wrong), len(wrong), len(rows) - len(ok), len(wrong) - 20)
    assert [tuple(r) for r in got["first"]] == wrong[:20]
    none = rates.validate_levels(df.limit(0), F.col("r"), F.col("c"), F.col("g")).first()
    assert (none.matches, none.mismatches, none.overflow, none["first"]) == (0, 0, 0, [])


def test_plays_of_equal_rows(spark):
    df = spark.createDataFrame([("S4 S2||DA",)] * 2 + [(None,), ("",)], "cardplay string")
    assert sorted(map(tuple, play.explode_plays(df).collect())) == sorted([(0, 0, "S", 4, 0), (0, 1, "S", 2, 1), (1, 0, "D", 14, 2)] * 2)


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"line {i}\n" for i in range(20_000)))
    rows = lines.read_lines(spark, str(tmp_path), 100)
    assert rows.rdd.getNumPartitions() < 70 and rows.count() == 20_000 and rows.select("start").distinct().count() == 2089


def test_scorers_give_any_numbers(spark):
    scoring.scorer_table(spark, "halves", lambda row: [{"x": row["v"], "s": 1, "n": row["v"] / 2}], "x double, s string, n long")
    df = spark.createDataFrame([(4,), (None,)], "v int")
    assert sorted(map(tuple, scoring.scored_by(df, "halves", []).collect()), key=str)[0][:3] == (4.0, "1", 2)
    plan = scoring.scored_by(df, "halves", [])._jdf.queryExecution().sparkPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
