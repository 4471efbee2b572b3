"""Operator 2, secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds, for each blob
and rule version, the spans that were found. A scan looks only at pairs of blob and rule version that
the ledger does not hold yet, appends them, and joins the ledger back to all paths; a text that is
kept under a thousand paths or in a hundred versions is scanned once.

Defined results: a null text is an empty one; an empty text and an empty table find nothing; repeated
rows each get their findings; positions count code points, the end is exclusive. Memory follows the
longest text and its matches; arrays grow in stretches of ``STRETCH``, so that a text with n matches takes
n * ``STRETCH`` steps, not their square.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and that length. A new version is scanned anew."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which they are listed where spans start together.
#: Too short a run of hex digits or after AKIA can hold no match, so their length is in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Public formats of keys that name themselves.
NAMED_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)

RULES = BASE_RULES + NAMED_RULES

#: Blobs with findings, and spans, that may be broadcast: at most some 100 bytes for each of either.
FOUND = 200_000

#: Matches that are put in one array one after the other.
STRETCH = 256

SPAN = "struct<kind:string,start:int,end:int>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end), without those too short.

    The texts between the matches give their places: a match starts after all the pieces and
    matches before it.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("piece"), matches.alias("match"), counted.alias("value")
    )
    def length(part: Column) -> Column:
        return F.length(part["piece"]) + F.coalesce(F.length(part["match"]), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        found = F.array(F.struct(F.lit(rule.kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(
            end.cast("int").alias("at"),
            F.when(F.length(part["value"]) >= rule.least, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    def own(stretch: Column, start: Column) -> Column:
        return F.aggregate(stretch, F.struct(start.cast("int").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda s: s["out"])

    found = bound(stretches(parts), lambda all_: F.flatten(F.zip_with(all_, before(all_, lambda s: F.aggregate(s, F.lit(0), lambda n, p: n + length(p)), lambda at, n: at + n), own)))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def bound(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is worked out once."""
    return F.transform(F.array(value), use)[0]


def stretches(values: Column) -> Column:
    """An array cut into arrays of ``STRETCH`` elements."""
    starts = lambda all_: F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int"))
    return bound(values, lambda all_: F.when(F.size(all_) > 0, F.transform(starts(all_), lambda i: F.slice(all_, i * STRETCH + 1, F.lit(STRETCH)))).otherwise(F.array(all_)))


def before(all_: Column, of, along) -> Column:
    """For each stretch, ``along`` the ints ``of`` those before it, from 0."""
    def step(s: Column, stretch: Column) -> Column:
        return F.struct(along(s["at"], of(stretch)).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    return F.aggregate(all_, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a ledger so far; an empty table where there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan every blob of ``versions`` for the rule versions that the ledger at ``path`` lacks; append them there."""
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    # copies of a blob fold into one before the shuffle, so a hot text is a row a task
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    wanted = F.array(*(F.lit(r.id) for r in rules))
    seen = ledger(spark, path).where(F.col("rule").isin([r.id for r in rules]))
    if seen.isEmpty():
        blobs = blobs.withColumn("missing", wanted)
    else:
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("missing", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("missing") > 0)
    found = blobs.select("blob", F.explode(F.array(*(
        F.when(F.array_contains("missing", r.id), F.struct(F.lit(r.id).alias("rule"), spans(F.col("body"), r).alias("spans"))) for r in rules
    ))).alias("f")).where("f is not null")
    found.select("blob", "f.rule", "f.spans").write.mode("append").parquet(path)


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``versions`` with ``blob`` and ``found``, all spans of the rules ordered by start, then rule.

    A pair that two scans at once have both appended counts once. Findings go to the rows, which then
    stay where they are, up to ``FOUND`` of them; beyond, both are shuffled by blob.
    """
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    own = ledger(versions.sparkSession, path).where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0))
    own = own.groupBy("blob", "rule").agg(F.min("spans").alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    own = own.select("blob", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    size = own.agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.size("found")).alias("spans")).first()
    if size["blobs"] <= FOUND and (size["spans"] or 0) <= FOUND:
        own = F.broadcast(own)
    rows = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return rows.join(own, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path``: a ledger to go on with; a new one without."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = path or f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"
    scan(docs, path)
    rows = findings(docs, path)

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return rows.select(
        "doc_id",
        *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(joined(of(*(r.kind for r in BASE_RULES))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars", path: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``[secret]``, and ``length`` of those rows counted anew; ``path``: a ledger to go on with."""
    path = path or f"{shared_dir(docs.sparkSession)}/secrets-{uuid.uuid4().hex}"
    scan(docs, path, text=text)
    body = F.col(f"row.{text}")
    rows = findings(docs.select(F.struct(*docs.columns).alias("row")), path, text=f"row.{text}")

    def furthest(stretch: Column) -> Column:
        return F.aggregate(stretch, F.lit(0), lambda n, f: F.greatest(n, f["end"]))

    def masked_stretch(stretch: Column, start: Column) -> Column:
        """The text from where the stretches before end to where this one does, of which a part is cut out once."""
        def step(s: Column, f: Column) -> Column:
            piece = F.concat(F.substring(s["text"], s["at"] - start + 1, f["start"] - s["at"]), F.lit("[secret]"))
            out = F.when(f["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"])
            return F.struct(F.greatest(f["end"], s["at"]).alias("at"), s["text"].alias("text"), out.alias("out"))

        own = F.substring(body, start + 1, F.greatest(furthest(stretch) - start, F.lit(0)))
        return F.aggregate(stretch, F.struct(start.alias("at"), own.alias("text"), F.array().cast("array<string>").alias("out")), step, lambda s: F.array_join(s["out"], ""))

    parts = bound(stretches(F.col("found")), lambda all_: F.array_join(F.zip_with(all_, before(all_, furthest, F.greatest), masked_stretch), ""))
    masked = F.concat(parts, F.substring(body, furthest(F.col("found")) + 1, F.length(body)))
    hit = F.size("found") > 0
    rows = rows.withColumn("masked", F.when(hit, masked))
    new = {text: F.when(hit, F.col("masked")).otherwise(body)}
    if length in docs.columns:
        new[length] = F.when(hit, F.length("masked").cast(docs.schema[length].dataType)).otherwise(F.col(f"row.{length}"))
    return rows.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def _sql_spans(rule: Rule) -> tuple[str, tuple[str, str, str]]:
    """A list of (start, rank, end, kind): the texts between the matches place them, as in ``spans``."""
    pattern = rule.pattern.replace("'", "''")
    parts = f"string_split_regex(body, '{pattern}')", f"regexp_extract_all(body, '{pattern}', 0)", f"regexp_extract_all(body, '{pattern}', {rule.group})"
    before = "list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)"
    return (f"list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {rule.least}), lambda i: {{'start': CAST({before} AS BIGINT), 'rank': {RULES.index(rule)}, "
            f"'stop': CAST({before} + length(m[i]) AS BIGINT), 'kind': '{rule.kind}'}})"), parts


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    steps, lists = [], []
    for rule in RULES:
        found, (pieces, matches, values) = _sql_spans(rule)
        lists.append(f"{rule.kind}_found")
        steps.append(f"(SELECT {found} FROM (SELECT {pieces} AS p, {matches} AS m, {values} AS v)) AS {rule.kind}_found")

    def line(found: str) -> str:
        return f"array_to_string(list_transform(list_sort({found}), lambda f: f.kind || ':' || f.start || ':' || f.stop), ',')"

    base = " || ".join(lists[: len(BASE_RULES)])
    return (f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), spans AS (SELECT doc_id, {', '.join(steps)} FROM docs) "
            f"SELECT doc_id, {', '.join(f'CAST(len({r.kind}_found) AS BIGINT) AS n_{r.kind}' for r in BASE_RULES)}, sha256({line(base)}) AS base_sha256, {line(' || '.join(lists))} AS spans FROM spans")
