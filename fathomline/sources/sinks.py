"""Writers: idempotent metric inserts, append-only readings, CSV reports, run summaries."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fathomline.operators import store
from fathomline.sources import schemas as S

METRICS_KEY = ["pair_id", "ledger_seq", "methodology_version", "data_source"]
HOLDER_KEY = ["code", "issuer", "snapshot_ledger", "methodology_version"]


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path).select(*(f"`{c}`" for c in like.columns))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], like.schema)


#: Column by which a reader sees the commit that a row came with.
BATCH = "committed"


class Contradiction(ValueError):
    """Rows whose parts contradict each other; nothing of them was stored."""


class _Folder:
    """A table of batches: the partition ``committed=<n>`` holds the rows of commit n. Batches are written to ``_staged`` and appear at once.

    Commit n is the file ``_commits/<n>.json``, which only one writer can create; it names the staged batch, which is then
    moved to its place. A writer that is lost before the commit leaves nothing that a reader sees; one that is lost
    between commit and move leaves a commit that the next writer or reader completes.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.path, self.of = spark, path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.files = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.utf8 = jvm.java.lang.String

    def commits(self) -> list[int]:
        at = self.of(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def complete(self) -> None:
        """Move the batches of commits whose writer was lost."""
        for n in self.commits():
            target = self.of(f"{self.path}/{_batch(n)}")
            if not self.files.exists(target):
                staged = json.loads(self.spark.read.text(f"{self.path}/_commits/{n}.json", wholetext=True).first()[0])["staged"]
                if staged and self.files.exists(self.of(staged)):
                    self.files.rename(self.of(staged), target)

    def commit(self, n: int, what: dict) -> bool:
        """Create commit n; False if another writer has."""
        at = self.of(f"{self.path}/_commits/{n}.json")
        if self.files.exists(at):
            return False
        try:
            out = self.files.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        self.complete()
        return True


def _batch(n: int) -> str:
    return f"{BATCH}={n}"


def _observed(seen: Observation, df: DataFrame, figures: list[Column]) -> dict:
    """What was observed of ``df``, or, where the plan left the observation out because nothing reached it, its figures anew."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return df.agg(*figures).first().asDict()


def insert_once(rows: DataFrame, path: str, key: list[str], time_col: str | None = None, violation: Column | None = None) -> dict:
    """Append the rows whose key is not stored yet, all or none, and return the figures of the batch; a rerun appends nothing.

    ``violation`` is null for good rows: any other row, stored before or not, raises ``Contradiction`` and nothing is stored.
    Violations, rows and the span of ``time_col`` are observed while the batch is written, so neither costs a pass. If another
    writer commits meanwhile, what it stored is left out and the batch is written anew.
    """
    spark, folder = rows.sparkSession, _Folder(rows.sparkSession, path)
    while True:
        folder.complete()
        n = len(folder.commits())
        given, stored = Observation(), Observation()
        bad = F.lit(None).cast("string") if violation is None else violation
        judged, faults = rows.withColumn("__bad", bad), [F.count("__bad").alias("violations"), F.min("__bad").alias("violation")]
        at = F.col(time_col) if time_col else F.lit(None).cast("timestamp")
        span = [F.count(F.lit(1)).alias("rows"), F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last")]
        new = store.insert_new(_stored(spark, path, rows), judged.observe(given, *faults).drop("__bad"), key)
        staged = f"{folder.path}/_staged/{uuid.uuid4().hex}"
        new.observe(stored, *span).write.parquet(staged)
        found = _observed(given, judged, faults)
        if found["violations"]:
            raise Contradiction(f"{found['violations']} contradicting rows, as: {found['violation']}")
        figures = _observed(stored, spark.read.schema(rows.schema).parquet(staged), span)
        if not figures["rows"]:
            return figures
        if folder.commit(n, {"staged": staged, **figures}):
            return figures


def save_metrics(rows: DataFrame, path: str) -> dict:
    """Validated metrics; raises where parts of a row contradict each other."""
    return insert_once(rows, path, METRICS_KEY, "ledger_closed_at" if "ledger_closed_at" in rows.columns else None, store.risk_violation(rows.columns))


def save_holder_reading(rows: DataFrame, path: str) -> dict:
    """Validated holder readings, one for each asset, ledger and version."""
    return insert_once(rows, path, HOLDER_KEY, "read_at" if "read_at" in rows.columns else None, store.holder_violation(rows.columns))


def save_trade_reading(rows: DataFrame, path: str) -> dict:
    """Validated trade readings; a deeper re-read of an anchor is kept beside the others, the same reading is stored once."""
    return insert_once(rows, path, rows.columns, "anchor", store.trade_violation(rows.columns))


def append(rows: DataFrame, path: str) -> None:
    """Readings that are kept side by side, deeper re-reads too."""
    rows.write.mode("append").parquet(path)


#: Ledgers of a partition of the trade log, as a power of two.
LOG_BITS = 17


def trade_log(trades: DataFrame, path: str) -> None:
    """Trades by spans of ledgers, in each file sorted by pair and ledger, so that a pair's range reads few files and few of their rows."""
    spans = trades.withColumn("span", F.shiftright("ledger_seq", LOG_BITS))
    spans.repartitionByRange("span", "pair_id", "ledger_seq", "trade_id").sortWithinPartitions("span", "pair_id", "ledger_seq", "trade_id").write.mode("append").partitionBy("span").parquet(path)


def trades_csv(trades: DataFrame, path: str) -> None:
    """The fixed trade columns in order; absent ones are empty."""
    names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^(]*\))", S.TRADES_CSV)]
    trades.select(*(F.col(n) if n in trades.columns else F.lit(None).cast("string").alias(n) for n in names)).write.mode("overwrite").option("header", True).csv(path)


def report_csv(rows: DataFrame, path: str) -> None:
    """A flat report; arrays are joined by a space, structs are refused by the writer."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), " ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def ladder_columns(risk: DataFrame) -> DataFrame:
    """Ladders as one column a rung, for the book-series report."""
    from fathomline.operators.risk import rung
    from fathomline.params import DEFAULT

    cols = []
    for d in DEFAULT.market_deltas:
        r = rung(F.col("depth"), d)
        cols += [r["buy_side"].alias(f"depth_buy_{d}"), r["sell_side"].alias(f"depth_sell_{d}")]
    for d in DEFAULT.manipulation_deltas:
        r = rung(F.col("manipulation"), d)
        cols += [r["book_cost"].alias(f"mc_cost_{d}"), r["target"].alias(f"mc_target_{d}"), r["book_reachable"].alias(f"mc_reachable_{d}")]
    return risk.select(*(c for c in risk.columns if c not in ("depth", "manipulation", "flag_states", "collateral", "oracle")), *cols)


def run_sidecar(rows: DataFrame, path: str, time_col: str = "closed_at") -> None:
    """One JSON row beside a report: rows, first and last time."""
    rows.agg(F.count(F.lit(1)).alias("rows"), F.min(time_col).alias("first"), F.max(time_col).alias("last")).write.mode("overwrite").json(path)
