"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A version of a file is a path and a text. Its blob is the SHA-256 of the text. The ledger has a row for each pair of
blob and rule version that was ever scanned, with its findings. A scan takes the versions whose pair the ledger
lacks, one text for each blob, scans them, appends the findings, and joins the ledger back to every path. So content
that comes again under another path, or stays through many versions, is scanned once for each set of rules.

Where a match lies follows from what lies between matches: the text split at the pattern gives the gaps, the pattern
extracted gives the matches, and a running sum over both gives code point offsets. The sum is a window over the rows
of one blob, so a text may have any number of matches.

A repeated or racing append may leave a pair more than one row, all equal; reading makes the pairs distinct, so a
result never doubles. Findings are joined back with hot blobs dealt over many tasks.

Edge cases: null text counts as empty; an empty text has no finding and a ledger row; rows with the same path or text
keep a row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEDGER_SCHEMA = "blob string, rules string, spans array<struct<kind: string, start: long, end: long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; ``base`` rules are the contract's."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    hint: str = ""  # a cheap pattern that any text with a kept match matches


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True, "[0-9a-f]{16}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY"),
    Rule("forge_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", hint="gh[pousr]_|glpat-|xox"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=r"\.eyJ"),
)


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:32]


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Of each match of the rule: kind's order, match's number, characters before it since the last one, its length, whether it stays."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    stays = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("length"), stays.alias("stays")),
        lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("n"), x["gap"].cast("long").alias("gap"), x["length"].cast("long").alias("length"), x["stays"].alias("stays")),
    )
    none = F.array().cast("array<struct<order: int, n: int, gap: bigint, length: bigint, stays: boolean>>")
    return F.when(text.rlike(rule.hint or rule.pattern), rows).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Of (blob, text), blobs distinct: a row each of blob and spans, by start, then kind as listed."""
    text = F.col("text")
    rows = blobs.select("blob", F.explode_outer(F.concat(*(_found(text, r, i) for i, r in enumerate(rules)))).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "order").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    kept = F.when(F.col("stays"), F.struct((F.col("end") - F.col("length")).alias("start"), "order", "end"))
    spans = F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(F.element_at(kinds, x["order"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.groupBy("blob").agg(spans.alias("spans"))


def read_ledger(spark, path: str, version: str) -> DataFrame | None:
    """blob and spans of the pairs with this rule version, each once; None where there is no ledger yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path).where(F.col("rules") == version)
    return rows.select("blob", "spans").dropDuplicates(["blob"])


def fill_ledger(texts: DataFrame, ledger_path: str, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the texts whose pair of blob and rule version the ledger lacks, one for each blob, and append the pairs."""
    spark, version = texts.sparkSession, rules_version(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    unseen = texts.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    known = read_ledger(spark, ledger_path, version)
    if known is not None:
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    found = scan(unseen.dropDuplicates(["blob"]), rules)
    with common.swept(spark):
        found.select("blob", F.lit(version).alias("rules"), "spans").write.mode("append").parquet(ledger_path)


def scan_versions(versions: DataFrame, ledger_path: str, *, path_cols: tuple[str, ...] = ("path",), text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``versions``: its path columns, blob and spans. The ledger gains the pairs that it lacked."""
    spark = versions.sparkSession
    paths = [f"path_{i}" for i in range(len(path_cols))]  # own names, as a path column may be called blob or spans
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob")
    with common.Scratch(spark) as scratch:
        keyed = scratch.table(versions.select(*(F.col(c).alias(p) for c, p in zip(path_cols, paths)), blob), "secret-paths")
        fill_ledger(versions, ledger_path, text_col=text_col, rules=rules)
        out = common.look_up(keyed, read_ledger(spark, ledger_path, rules_version(rules)), "blob")
        out = scratch.keep(scratch.table(out.select(*paths, "blob", "spans"), "secret-findings"))
    return out.toDF(*path_cols, "blob", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in its text replaced by ``mask``; overlapping spans become one mask. Columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob, spans = common.free(docs.columns, "secret_blob", "secret_spans")
    ledger_path = ledger_path or common.scratch_path(docs.sparkSession, "ledger")
    fill_ledger(docs, ledger_path, text_col=text_col, rules=rules)
    found = read_ledger(docs.sparkSession, ledger_path, rules_version(rules)).where(F.size("spans") > 0)
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, x: Column) -> Column:
        clear = x["start"] >= state["upto"]
        piece = F.substr(F.col(text_col), (state["upto"] + 1).cast("int"), (x["start"] - state["upto"]).cast("int"))
        parts = F.when(clear, F.concat(state["parts"], F.array(F.concat(piece, F.lit(mask))))).otherwise(state["parts"])
        return F.struct(F.greatest(state["upto"], x["end"]).alias("upto"), parts.alias("parts"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substr(F.col(text_col), (state["upto"] + 1).cast("int")))

    masked = F.when(F.col(spans).isNotNull(), F.aggregate(spans, zero, step, finish)).otherwise(F.col(text_col))
    out = common.look_up(docs.withColumn(blob, F.sha2(text, 256)), found, blob, "left").withColumn(text_col, masked)
    return out.select(*docs.columns)


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    out = scan_versions(common.documents(spark, sf_dir), common.scratch_path(spark, "ledger"), path_cols=("doc_id",))
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    patterns = [r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", names) for r in RULES]
    found = "\nUNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {k} AS k, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS whole, "
        f"list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x) >= {r.least}) AS stays FROM t WHERE regexp_matches(text, '{p}')"
        for k, (r, p) in enumerate((r, p.replace("'", "''")) for r, p in zip(RULES, patterns))
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS ({found}),
m AS (SELECT *, unnest(generate_series(1, len(whole))) AS n FROM g),
p AS (SELECT doc_id, kind, k, stays[n] AS stays, length(whole[n]) AS size,
        CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM m),
s AS (SELECT doc_id, k, start, kind || ':' || start || ':' || (start + size) AS span FROM p WHERE stays),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


SQL = _sql()
