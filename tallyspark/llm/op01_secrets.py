"""Secret scans over an incremental blob ledger (operator 1).

Every historical version of a file is a row of (path columns, text).  A
version's content address is the SHA-256 of its text.  The ledger is a Parquet
folder with one row per blob and run: the rule versions that the run applied
to the blob (``pairs``) and the spans they found.  A run scans only the (blob,
rule version) pairs that no earlier run has recorded, appends what it did, and
joins the findings of the wanted rule versions back to all paths.  Raising a
rule's version makes only that rule run again; copies of a text are scanned
once.

Spans are found with SQL functions only: ``regexp_extract_all`` gives the
matches of a rule, left to right without overlap, ``split`` the text between
them, and the running sum of both lengths their places in code points.

Null texts count as empty.  Repeated rows each get their findings.  Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, shared_path, whole_text

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; group ``group`` of a match must have ``least`` characters, else the match is dropped.

    ``needs``: a literal without which no match is possible (a cheap test before the pattern).
    """
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: str = ""

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


#: FIXED VALUES of the query's contract, in its order.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
_KEY = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\s|\\[nr])"
#: More kinds of published credential formats, each found whole.  A private key goes up to its END line; without one, over its
#: header lines and base64 lines.
MORE_RULES = (
    Rule("private_key", 2, rf"-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {_KEY}"
         rf"|(?:{_BREAK}*+[A-Za-z-]++:\x20[^\r\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{20,}}+)*+"
         rf"(?:{_BREAK}++[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*+(?:[\r\n]|\\[nr]|\Z)))?+(?:{_BREAK}++=[A-Za-z0-9+/]{{4}})?+)",
         needs="PRIVATE KEY"),
    Rule("code_host", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", needs="_"),
    Rule("chat_app", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="eyJ"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]++:[^\s/:@]++@", needs="://"),
)
RULES = BASE_RULES + MORE_RULES
#: The pipeline's name for the same rules.
WHOLE_RULES = RULES


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """All kept matches of a rule as an array of (start, rank, end, kind)."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["between"])
        end = start + F.char_length(m["found"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        none = F.array().cast(SPANS)
        kept = F.when(F.char_length(m["group"]) >= rule.least, one.cast(SPANS)).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    matches = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"), group.alias("group"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    spans = F.aggregate(matches, start, step, lambda acc: acc["spans"])
    possible = text.rlike(rule.pattern)
    if rule.needs:
        possible = F.when(text.contains(rule.needs), text.rlike(rule.pattern)).otherwise(False)
    return F.when(possible, spans).otherwise(F.array().cast(SPANS))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows (blob, pairs, spans), or None where nothing has been written."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob binary, pairs array<string>, spans {SPANS}").parquet(ledger)


def blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct contents: (blob, body).  Copies meet in the map tasks first, so a hot content is one row a task."""
    body = whole_text(text_col)
    return versions.select(F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("body")) \
        .groupBy("blob").agg(F.first("body").alias("body"))


def scan_unseen(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
    """Scan the (blob, rule version) pairs that the ledger doesn't have and append them to it."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    fresh, seen = blobs(versions, text_col), read_ledger(spark, ledger)
    if seen is None:
        fresh = fresh.withColumn("pairs", wanted)
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("done"))
        fresh = fresh.join(done, "blob", "left") \
            .withColumn("pairs", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))) \
            .filter(F.size("pairs") > 0)
    spans = F.concat(*[
        F.when(F.array_contains("pairs", r.pair), rule_spans(F.col("body"), r, k)).otherwise(F.array().cast(SPANS))
        for k, r in enumerate(rules)])
    fresh.select("blob", "pairs", F.array_sort(spans).alias("spans")).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings under the wanted rules, ordered by start and rule."""
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    rows = read_ledger(spark, ledger).filter(F.size("spans") > 0) \
        .filter(F.arrays_overlap("pairs", F.array(*[F.lit(r.pair) for r in rules])))
    one = rows.select("blob", F.explode(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind")))).alias("s"), "pairs")
    current = F.array_contains("pairs", F.concat(F.col("s.kind"), F.lit("@"), F.element_at(
        F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(str(r.version)))]), F.col("s.kind"))))
    return one.filter(current).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def scan(versions: DataFrame, path_cols: Sequence[str], ledger: str | None = None, rules: Sequence[Rule] = RULES,
         text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(path columns, spans) for every version, scanning only what the ledger hasn't seen.

    Without ``ledger`` a new one is kept in the shared folder for this run.
    ``with_text`` keeps the versions' own columns.
    """
    spark = versions.sparkSession
    prepare(spark)
    ledger = ledger or shared_path(spark, "ledger")
    scan_unseen(versions, ledger, rules, text_col)
    keep = [F.col(f"`{c}`") for c in (versions.columns if with_text else path_cols)]
    paths = versions.select(*keep, F.unhex(F.sha2(whole_text(text_col), 256)).alias("blob_"))
    found = findings(spark, ledger, rules).select(F.col("blob").alias("blob_"), F.col("spans").alias("spans_"))
    return paths.join(found, "blob_", "left").withColumn("spans_", F.coalesce("spans_", F.array().cast(SPANS))) \
        .drop("blob_").withColumnRenamed("spans_", "spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns from the findings of every document."""
    rows = scan(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span replaced; spans that overlap or touch are replaced as one."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        joined = (s["start"] <= acc["at"]) & (acc["at"] > 0) & (acc["any"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"),
            F.lit(True).alias("any"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("any"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
