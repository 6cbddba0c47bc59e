"""What the plans do not do: move texts, sort lists, read folders or tables that nobody asked for."""

import contextlib
import io
import json
import re

from pyspark.sql import functions as F

from cuesheet import registry
from cuesheet.functions import skew
from cuesheet.functions.titles import DEFAULT_RULES
from cuesheet.operators import rules, second_pass, sets
from cuesheet.sources import bronze

SF = "/root/testdata/sf0.001"


def plan_of(df):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        df.explain("formatted")
    return told.getvalue()


def test_best_lists_come_without_sorting_lists(spark):
    registry.load_all()
    plan = plan_of(registry.QUERIES["flagship_setlists"](spark, SF))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_best_source_of_ties_and_odd_places(lists):
    def one(source, place, artists):
        made = lists({1: [(i, f"s{i}", a) for i, a in enumerate(artists)]})
        return made.withColumn("source", F.lit(source)).withColumn("source_pos", F.lit(place).cast("bigint"))

    def best(*parts):
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return [(r.source, r.source_pos) for r in sets.select_best_source(every).collect()]

    big = 2**62
    assert best(one("comment", 5, "ab"), one("comment", 2, "ab"), one("description", 1, "ab")) == [("comment", 2)]
    assert best(one("comment", 5, ["a", ""]), one("description", big, "ab")) == [("description", big)]
    assert best(one("comment", 9, "abc"), one("comment", 1, "ab"), one("comment", None, "abc")) == [("comment", 9)]
    assert best(one("comment", big, "ab"), one("comment", -big, "ab")) == [("comment", -big)]
    assert best(one("comment", 1, []), one("comment", 2, [])) == []


def test_comment_texts_stay_where_they_were_found(spark):
    said = lambda *texts: json.dumps(
        [{"commentEntityPayload": {"properties": {"content": {"content": t}}}} for t in texts]
    )
    rows = [("v", "replies", 2, said("e")), ("v", "comments", 0, said("a", "b")), ("v", "replies", 1, said("c", "d")),
            ("w", "comments", 0, said()), ("w", "replies", 0, said("x")), ("v", "comments", 0, said("b2")),
            (None, "comments", 0, said("n")), ("v", "initial", 0, said("no")), ("v", "replies", 0, "{")]
    payloads = spark.createDataFrame(rows, bronze.PAYLOAD_SCHEMA).coalesce(1)
    found = bronze.extract_comments(payloads)
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange\s*\n(?:.*\n)?Input.*text", plan)
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    got = sorted((r.yt_id or "", r.comment_pos, r.text) for r in found.collect())
    assert got == [("", 1, "n"), ("v", 1, "a"), ("v", 2, "b"), ("v", 3, "b2"), ("v", 4, "c"), ("v", 5, "d"),
                   ("v", 6, "e"), ("w", 1, "x")]


def test_cache_reads_the_wanted_buckets_only(spark, tmp_path):
    shape = f"{bronze.PAYLOAD_SCHEMA}, fetched_at timestamp"
    path = str(tmp_path / "cache")
    for day in (1, 3, 2):
        rows = [(f"v{i}", "initial", p, f"{i}-{p}-{day}") for i in range(40) for p in (0, 1)]
        raw = spark.createDataFrame(rows, bronze.PAYLOAD_SCHEMA).withColumn(
            "fetched_at", F.to_timestamp(F.lit(f"2024-01-0{day}"))
        )
        bronze.append_raw(raw.select(*[c.split()[0] for c in shape.split(", ")]), path, buckets=32)
    wanted = spark.createDataFrame([("v3",), ("v7",), ("v3",), ("none",)], "yt_id string")
    found = bronze.read_latest(spark, path, wanted, buckets=32)
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", plan_of(found))
    assert filters and all("bucket" in f for f in filters)
    assert all(len(set(re.findall(r"\d+", f.split("IN", 1)[1]))) <= 4 for f in filters if "IN" in f)
    got = sorted((r.yt_id, r.part_pos, r.json) for r in found.collect())
    assert got == [("v3", 0, "3-0-3"), ("v3", 1, "3-1-3"), ("v7", 0, "7-0-3"), ("v7", 1, "7-1-3")]
    assert bronze.read_latest(spark, path, buckets=32).count() == 80


def test_rule_sets_share_one_scan(spark, tmp_path):
    cases = [("3. x (練習)", "x", ""), ("y (練習)", "y (練習)", "")]
    spark.createDataFrame(cases, "input string, expect_song string, expect_artist string").write.parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    versions = {"all": DEFAULT_RULES, "no notes": tuple(r for r in DEFAULT_RULES if r.rule_id != "R07"), "none": ()}
    checked = rules.check_rules(versions, table)
    assert plan_of(checked).count("Scan parquet") == 2  # in the tree and in its description
    got = {r.rule_set: (r.cases, r.failures, r.passed) for r in checked.collect()}
    assert got == {"all": (2, 1, False), "no notes": (2, 0, True), "none": (2, 0, True)}
    detail = rules.check_rules(versions, table, detail=True)
    assert detail.count() == 6 and {"rule_set", "input_clean", "fired", "failed", "input"} <= set(detail.columns)


def test_request_files_are_the_same_again(spark, tmp_path):
    texts = [(v, i, f"{v}{i} " + "x" * (7 * i)) for v in "abc" for i in range(12)]
    comments = spark.createDataFrame(texts, "video_id string, source_pos bigint, text string")
    seen = []
    for parts in (1, 5):
        lines = second_pass.request_lines(comments.repartition(parts), "T", "m", most=150)
        path = str(tmp_path / f"r{parts}")
        for _ in range(2):
            stored = second_pass.write_requests(lines, path, file_chars=900)
        rows = [(r.shard, r.value) for r in stored.collect()]
        seen.append(sorted(rows))
        size = {}
        for shard, value in rows:
            size[shard] = size.get(shard, 0) + len(value) + 1
        assert max(size.values()) < 900 + max(len(v) for _, v in rows) and len(size) > 2
    assert seen[0] == seen[1]
    said = {}
    for _, value in seen[0]:
        body = json.loads(value)
        video, part = body["custom_id"].split("-")
        content = body["body"]["input"][1]["content"]
        assert content.startswith("T\n")
        said.setdefault(video, {})[int(part)] = content[2:].split("\n\n---\n\n")
    for v in "abc":
        assert [t for part in sorted(said[v]) for t in said[v][part]] == [t for w, _, t in texts if w == v]


def test_running_total_over_many_ranges(spark):
    rows = [("k" if i % 3 else None, i, (i * 7) % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, w int").repartition(7)
    got = skew.running_total(df, ["k"], ["i"], F.col("w"), "upto").collect()
    total = {}
    want = {}
    for k, i, w in rows:
        want[i] = total[k] = total.get(k, 0) + w
    assert {r.i: r.upto for r in got} == want
