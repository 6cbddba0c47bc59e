"""Rule table: apply over a corpus, count hits, collect proposals, gate changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..functions.text import strip
from ..functions.titles import (
    DEFAULT_RULES, HAS_BRACKET, Rule, _PLAIN_FIELD, _PLAIN_NUMBER, join_song_artist, protected_pattern, rule_step, song_slash,
    tidy_field,
)

RULE_SCHEMA = (
    "rule_id STRING, ord INT, category STRING, action STRING, regex STRING, "
    "replacement STRING, scope STRING, protection ARRAY<STRING>"
)


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """The rule table as a DataFrame, to be stored and edited as data."""
    return spark.createDataFrame(
        [
            (r.rule_id, r.ord, r.category, r.action, r.regex, r.replacement, r.scope,
             list(r.protection))
            for r in rules
        ],
        RULE_SCHEMA,
    )


def load_rules(table: DataFrame, most: int | None = 10_000) -> tuple[Rule, ...]:
    """Read a rule table (a few dozen rows) back, so that patterns are plan literals."""
    return tuple(
        Rule(r.rule_id, r.ord, r.category, r.action, r.regex, r.replacement or "", r.scope,
             tuple(r.protection or ()))
        for r in small_table(table.orderBy("ord"), most)
    )


def small_table(table: DataFrame, most: int | None = 10_000) -> list:
    """Rows of a table that must be small; a larger one is an error, never cut.

    ``most`` is the number of plan literals that the caller is ready for; None: any.
    """
    if most is None:
        return table.collect()
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a rule table")
    return rows


def apply_title_rules(
    tracks: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, column: str = "song"
) -> DataFrame:
    """Add ``<column>_clean`` and ``fired``, the rules that changed the field, in order.

    One projection per rule; the optimiser keeps them apart, because each value is read
    twice, and one generated stage runs them all.
    """
    ordered = sorted(rules, key=lambda r: r.ord)
    keep = list(tracks.columns)
    raw = F.col("_raw")
    df = tracks.withColumn("_raw", strip(F.coalesce(F.col(column), F.lit(""))))
    df = df.withColumn(
        "_guard", (raw == "") | raw.rlike(protected_pattern(rules)) | raw.rlike(_PLAIN_NUMBER)
    )
    # a plain name is changed by no rule, and a field without brackets by no suffix rule
    plain = raw.rlike(_PLAIN_FIELD) if rules is DEFAULT_RULES else F.lit(False)
    df = df.withColumn("_plain", plain).withColumn("_flat", ~raw.rlike(HAS_BRACKET))
    skip = lambda flag, c, out: F.when(F.col(flag), F.col(c)).otherwise(out)
    prev, marks = "_raw", []
    for i, rule in enumerate(r for r in ordered if r.scope == "field"):
        df = df.withColumn(f"_p{i}", skip("_plain", prev, rule_step(F.col(prev), rule)))
        marks.append((rule.rule_id, prev, f"_p{i}"))
        prev = f"_p{i}"
    df = df.withColumn("_t", strip(F.col(prev))).withColumn("_at", song_slash(F.col("_t")))
    df = df.withColumn(
        "_s",
        F.when(F.col("_at").isNull(), F.col("_t")).otherwise(
            F.substring("_t", F.lit(1), F.col("_at"))
        ),
    )
    prev = "_s"
    for i, rule in enumerate(r for r in ordered if r.scope == "song"):
        step = rule_step(F.col(prev), rule)
        if rules is DEFAULT_RULES:
            step = skip("_flat", prev, step)
        df = df.withColumn(f"_q{i}", step)
        marks.append((rule.rule_id, prev, f"_q{i}"))
        prev = f"_q{i}"
    artist = F.when(F.col("_at").isNotNull(), F.substring("_t", F.col("_at") + 2, F.length("_t")))
    ruled = F.when(F.col("_guard"), raw).otherwise(join_song_artist(F.col(prev), artist))
    fired = F.filter(
        F.array(*[F.when(F.col(a) != F.col(b), F.lit(rid)) for rid, a, b in marks]),
        lambda r: r.isNotNull(),
    )
    protected = raw.rlike(protected_pattern(rules))
    return df.withColumn("_ruled", ruled).select(
        *keep,
        F.when(F.col("_plain") | protected, raw).otherwise(tidy_field(F.col("_ruled")))
        .alias(f"{column}_clean"),
        F.when(F.col("_guard"), F.array().cast("array<string>")).otherwise(fired).alias("fired"),
    )


def rule_stats(cleaned: DataFrame, column: str = "song") -> DataFrame:
    """Hits, distinct titles and share of rows per rule.

    Titles are counted once per distinct title first, so a rule that fires on a third of
    the corpus is summed on the map side.
    """
    per_title = cleaned.groupBy(column, "fired").agg(F.count("*").alias("_n"))
    # the empty rule id counts every row
    every = F.explode(F.concat(F.array(F.lit("")), F.col("fired")))
    per_rule = (
        per_title.select(column, "_n", every.alias("rule_id"))
        .groupBy("rule_id", column).agg(F.sum("_n").alias("_n"))
        .groupBy("rule_id")
        .agg(F.sum("_n").alias("hits"), F.count("*").alias("titles"))
    )
    # one row per rule is left here
    total = F.max(F.when(F.col("rule_id") == "", F.col("hits"))).over(Window.partitionBy())
    return per_rule.select(
        "rule_id", "hits", "titles", (F.col("hits") / total).alias("share")
    ).where(F.col("rule_id") != "")


# --- proposals and the regression gate ------------------------------------------------------

_PROPOSAL = """
rules ARRAY<STRUCT<category: STRING, description: STRING, action: STRING, regex: STRING,
  examples: ARRAY<STRUCT<input: STRING, output: STRING>>, protection: ARRAY<STRING>>>,
notes ARRAY<STRING>
"""
_CHANGES = """ARRAY<STRUCT<function: STRING, kind: STRING, old_regex: STRING, new_regex: STRING,
  js_function: STRING, py_regex: STRING,
  tests: ARRAY<STRUCT<input: STRING, expect_song: STRING, expect_artist: STRING>>>>"""
_FIELDS = {
    "category": "string", "description": "string", "action": "string", "regex": "string",
    "examples": "array<struct<input:string,output:string>>", "protection": "array<string>",
    "function": "string", "kind": "string", "old_regex": "string", "new_regex": "string",
    "js_function": "string", "py_regex": "string",
    "tests": "array<struct<input:string,expect_song:string,expect_artist:string>>", "note": "string",
}


def collect_rule_proposals(responses: DataFrame, key: str, text: str = "response") -> DataFrame:
    """One row per proposed rule, change or note; a response without valid JSON is a note.

    Two shapes are read: an object with ``rules`` and ``notes`` between the first ``{`` and
    the last ``}``, and an array of changes between the first ``[`` and the last ``]``.  All
    their fields are columns; those of the other shape are null.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    body = F.regexp_extract(said, r"(?s)\{.*\}", 0)
    listed = F.regexp_extract(said, r"(?s)\[.*\]", 0)
    parsed = responses.select(
        key, F.from_json(body, _PROPOSAL).alias("p"), F.from_json(listed, _CHANGES).alias("c"),
        body.alias("_b"),
    )

    def row(**values):
        return F.struct(
            *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()]
        )

    none = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">>")
    no_object = F.col("p").isNull() | (F.col("p.rules").isNull() & F.col("p.notes").isNull())
    changes = F.filter("c", lambda c: c["function"].isNotNull() | c["kind"].isNotNull())
    is_list = no_object & (F.coalesce(F.size(changes), F.lit(0)) > 0)
    empty_list = no_object & (F.size("c") == 0)
    old = ("category", "description", "action", "regex", "examples", "protection")
    new = ("function", "kind", "old_regex", "new_regex", "js_function", "py_regex", "tests")
    proposed = F.concat(
        F.coalesce(F.transform("p.rules", lambda r: row(**{n: r[n] for n in old})), none),
        F.coalesce(F.transform("p.notes", lambda n: row(note=n)), none),
    )
    reason = F.when(F.col("_b") == "", "no JSON object").otherwise("not valid JSON")
    rows = (
        F.when(is_list, F.transform(changes, lambda c: row(**{n: c[n] for n in new})))
        .when(F.coalesce(empty_list, F.lit(False)), none)
        .when(no_object, F.array(row(note=reason))).otherwise(proposed)
    )
    return explode_rows(parsed, rows, [key], "r").select(key, "r.*")


def check_rules(
    rule_sets: dict[str, tuple[Rule, ...]], cases: DataFrame, detail: bool = False
) -> DataFrame:
    """Run candidate rule sets over golden cases; a set passes when no case fails.

    A case fails when the cleaned input lacks the expected title or performer.  The few
    rule sets are plan literals; the cases are the table that grows, and it is read once: every
    set is a column of that scan, and the columns are then stacked into rows.
    """
    keep = cases.columns
    checked, versions = cases, []
    for i, (name, rules) in enumerate(rule_sets.items()):
        clean, fired = f"_clean{i}", f"_fired{i}"
        checked = apply_title_rules(checked, rules, "input").withColumnsRenamed(
            {"input_clean": clean, "fired": fired}
        )
        versions.append(
            F.struct(F.lit(name).alias("rule_set"), F.col(clean).alias("input_clean"), F.col(fired).alias("fired"))
        )
    if not versions:
        raise ValueError("no rule set to check")
    stacked = explode_rows(checked, F.array(*versions), keep, "v").select(*keep, "v.*")
    missing = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col("input_clean").contains(F.col(c))
    result = stacked.withColumn("failed", missing("expect_song") | missing("expect_artist"))
    if detail:
        return result
    return result.groupBy("rule_set").agg(
        F.count("*").alias("cases"), F.count_if("failed").alias("failures"),
        (~F.bool_or("failed")).alias("passed"),
    )
