import json

from cuesheet.sources import bronze


def test_embedded_json(spark):
    pages = [
        (1, 'x"INNERTUBE_API_KEY":"k" var ytInitialData = {"a": "}\\"{", "b": {"c": 1}}; rest }'),
        (2, "nothing"), (3, "ytInitialData = null"), (4, 'ytInitialData = {"a": "}'), (5, "ytInitialData = {a}"),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = bronze.extract_embedded_json(df, "ytInitialData").orderBy("page_id").collect()
    assert json.loads(got[0].json) == {"a": '}"{', "b": {"c": 1}} and got[0].api_key == "k"
    assert [r.error for r in got[1:]] == [
        "ytInitialData not found", "ytInitialData object start not found", "ytInitialData object end not found",
        "ytInitialData object is not valid JSON",
    ]


def test_walk_keeps_document_order(spark):
    say = lambda t: {"commentEntityPayload": {"properties": {"content": {"content": t}}}}
    doc = {"z": [say("1"), {"deep": say("2")}], "a": say("3"), "bad": say(5)}
    rows = [("y", "comments", 0, json.dumps(doc)), ("y", "initial", 0, json.dumps(say("no"))), ("y", "reply", 0, json.dumps(say("4"))),
            ("y", "reply", 1, "not json")]
    df = spark.createDataFrame(rows, "yt_id string, part string, part_pos int, json string")
    got = bronze.extract_comments(df).orderBy("comment_pos").collect()
    assert [r.text for r in got] == ["1", "2", "3", "4"]
    again = bronze.extract_comments(bronze.walk_payloads(df)).orderBy("comment_pos").collect()
    assert got == again


def test_deep_tree(spark):
    deep = {"simpleText": "1:00 歌"}
    for _ in range(400):
        deep = {"k": [deep]}
    df = spark.createDataFrame([("y", "initial", 0, json.dumps(deep))], "yt_id string, part string, part_pos int, json string")
    assert bronze.extract_descriptions(df).collect()[0].description == "1:00 歌"


def test_frontier(spark):
    reply = lambda t: {"commentRepliesRenderer": {"contents": [{"continuationItemRenderer": {
        "continuationEndpoint": {"continuationCommand": {"token": t}}}}]}}
    first = {"items": [{"continuationEndpoint": {"continuationCommand": {"token": "other"}}}]}
    rows = [("y", "initial", 0, json.dumps(first)),
            ("y", "comments", 0, json.dumps([reply("a"), reply("b"), reply("a")])), ("y", "reply", 0, json.dumps([reply("c")]))]
    df = spark.createDataFrame(rows, "yt_id string, part string, part_pos int, json string")
    seen = spark.createDataFrame([("y", "a")], "yt_id string, token string")
    got = bronze.crawl_frontier(df, seen, cap=2).collect()
    assert {(r.kind, r.token) for r in got} == {("comments", "other"), ("reply", "b")}


def test_frontier_walks_once(spark):
    page = {"tabs": [{"continuationEndpoint": {"continuationCommand": {"token": "m"}}, "label": "Comments"}]}
    reply = {"commentRepliesRenderer": {"contents": [{"continuationItemRenderer": {
        "continuationEndpoint": {"continuationCommand": {"token": "r"}}}}]}}
    rows = [("y", "initial", 0, json.dumps([page, reply])), ("y", "reply", 0, json.dumps([page, reply]))]
    df = spark.createDataFrame(rows, "yt_id string, part string, part_pos int, json string")
    got = bronze.crawl_frontier(df, spark.createDataFrame([("y", "x")], "yt_id string, token string"), cap=1)
    # the payloads are not parsed again by the plan that reads their tokens
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert {(r.kind, r.token) for r in got.collect()} == {("comments", "m"), ("reply", "r")}
    # a first page has kinds of its own
    walked = bronze.walk_payloads(df, ("reply",), ("any_token",)).collect()
    assert sorted((r.part, r.kind, r.text, r.nth) for r in walked) == [
        ("initial", "any_token", "m", 1), ("initial", "any_token", "r", 2), ("reply", "reply", "r", 1),
    ]


def test_timed_texts(one):
    from pyspark.sql import functions as F

    texts = {"0:15": False, "a0:15": False, "ab0:15": True, "丨丨 0:15": False, "歌 0:15": True, "ab": False, "0:15 ♪あ": True,
             "0:155 ab": False, "ab 0:15 0:16": True, "a0:15 b0:16": False, "x:0:15": True, "": False, None: False}
    assert one(bronze.is_timed_text, list(texts)) == list(texts.values())
    slow = lambda c: F.regexp_replace(F.regexp_replace(c, bronze._ANY_TIME, ""), bronze._NOT_TEXT, "").rlike("[A-Za-zぁ-んァ-ヶ一-龯々]")
    times = [t for t in texts if t and "0:15" in t and "0:155" not in t]
    assert one(slow, times) == one(bronze.is_timed_text, times)


def test_raw_append(spark, tmp_path):
    df = spark.createDataFrame([("y", "initial", 0, "{}", 1), ("y", "initial", 0, "{1}", 2)], "yt_id string, part string, part_pos int, json string, fetched_at int")
    bronze.append_raw(df, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert bronze.latest_raw(back).collect()[0].json == "{1}"
