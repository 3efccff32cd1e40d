"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text version is addressed by its content (SHA-256). The ledger keeps, in
a folder, which rules at which version have scanned which blob, and what they
found. ``update`` lists the paths of the given versions, scans only pairs of
blob and rule version that the ledger has not seen, each blob once however
many paths hold it, and joins the findings back to all paths.

A rule's matches are leftmost and non-overlapping; positions are code points
and come from running sums over the lengths of matches and of the text between
them. A match whose value group is too short is dropped after matching.

Defined results: a null text is an empty one; a null doc_id is a path like any
other; repeated rows give repeated result rows. Findings are written before the
pairs are marked as seen, so a run that dies in between scans them again and
the distinct read hides the repetition. Extra columns are kept apart by
``redacted`` and ignored otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import forget, store
from washframe.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind; ``group`` must hold ``least`` characters or more."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values of the base rules; the last rule is an addition.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings, in a folder."""

    def __init__(self, spark, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.path = (path or scratch_path(spark, "ledger")).rstrip("/")
        self.runs: list[str] = []

    def _table(self, name: str, schema: str) -> DataFrame:
        """All runs' rows of a ledger table; an empty one before the first run."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")

    def seen(self) -> DataFrame:
        return self._table("seen", "blob binary, rule string").distinct()

    def findings(self) -> DataFrame:
        """(blob, rule, kind, start, end), each finding once."""
        return self._table("findings", "blob binary, rule string, kind string, start long, end long").distinct()

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scan what is new and return one row per input row: (doc_id, blob)."""
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        versions = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
        versions = versions.withColumn("blob", F.unhex(F.sha2("text", 256)))
        paths = store(versions.select("doc_id", "blob"), "ledger-paths")
        wanted = paths.groupBy("blob").agg(F.min("doc_id").alias("one"))
        rules = F.array(*[F.lit(r.key) for r in self.rules])
        todo = wanted.select("blob", "one", F.explode(rules).alias("rule")).join(
            self.seen(), ["blob", "rule"], "left_anti")
        todo = store(todo.groupBy("blob", "one").agg(F.collect_set("rule").alias("rules")), "ledger-todo")
        run = uuid.uuid4().hex
        source = versions.alias("v").join(
            todo.alias("t"), (F.col("v.blob") == F.col("t.blob")) & F.col("v.doc_id").eqNullSafe(F.col("t.one")))
        self._scan(source.select("t.blob", "t.rules", "v.text")).write.parquet(f"{self.path}/findings/{run}")
        todo.select("blob", F.explode("rules").alias("rule")).write.parquet(f"{self.path}/seen/{run}")
        forget(todo)
        return paths

    def _scan(self, texts: DataFrame) -> DataFrame:
        """Findings of (blob, rules, text): lengths of the gaps and matches of every
        rule, then running sums over them, one group per blob and rule."""
        found = []
        for r in self.rules:
            on = F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern)
            gaps = F.transform(F.split("text", r.pattern, -1), F.length)
            hits = F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length)
            held = F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length)
            found.append(F.when(on, F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"),
                                             F.lit(r.least).alias("least"), gaps.alias("gaps"),
                                             hits.alias("hits"), held.alias("held"))))
        rows = (texts.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
                .select("blob", "f.rule", "f.kind", "f.least", F.posexplode(
                    F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.hits")).alias("gap"),
                                 F.col("f.hits").alias("hit"), F.col("f.held").alias("held"))).alias("i", "z"))
                .dropDuplicates(["blob", "rule", "i"]))
        end = "sum(z.gap + z.hit) OVER (PARTITION BY blob, rule ORDER BY i)"
        return (rows.selectExpr("blob", "rule", "kind", f"{end} - z.hit AS start", f"{end} AS end",
                                "z.held >= least AS ok").where("ok").drop("ok"))

    def report(self, paths: DataFrame) -> DataFrame:
        """Findings joined back to every path: per path and kind counts, the base
        spans' digest, all spans as text and as an array."""
        order = F.create_map(*[x for i, r in enumerate(self.rules) for x in (F.lit(r.kind), F.lit(i))])
        now = F.array(*[F.lit(r.key) for r in self.rules])
        per = self.findings().where(F.array_contains(now, F.col("rule"))).groupBy("blob").agg(F.sort_array(
            F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), "kind", "end"))).alias("spans"))
        # stored, so that a blob with very many paths can be split in the join
        per = store(per, "ledger-spans")
        none = F.array().cast(per.schema["spans"].dataType)
        rows = paths.join(per, "blob", "left").withColumn("spans", F.coalesce("spans", none))

        def joined(spans):
            return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

        base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

        def count(kind):
            return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

        counts = [count(k) for k in BASE]
        return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                           joined("spans").alias("spans"), "blob", F.col("spans").alias("found"))


def redacted(spark, docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text",
             ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; other columns and rows
    stay. Overlapping spans become one mark."""
    ledger = ledger or BlobLedger(spark)
    paths = ledger.update(docs, id_col, text_col)
    found = store(ledger.findings().groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found")), "ledger-redact")
    forget(paths)
    # the caller's columns stay inside a struct, so none can clash with these names
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(columns, text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("blob"))
    rows, text = rows.join(found, "blob", "left"), F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(inside)

    done = F.aggregate("found", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    out = F.when(F.col("found").isNull(), text).otherwise(done)
    return rows.select(*[out.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
