"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger is two tables: which blob was
scanned with which rule version, and what was found. A scan looks only at blobs the ledger has not seen with the
present rule version, appends to the ledger, and joins the findings back to all paths that hold the blob.

Blobs travel compressed, once per task and content, so a text held by a third of all paths is shuffled once per task.
Findings are written before the scanned marks and read back as distinct rows, so a run that ends in between costs a
second scan and changes nothing.

Defined results: a NULL text is the empty text; repeated rows are paths of one blob and all get its findings; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import few_files
from .common import scratch

# The base kinds, in this order, and the kinds added here.
BASE_KINDS = ["assign", "access", "hex"]
ADDED_KINDS = ["private_key", "service_token", "signed_token"]
KINDS = BASE_KINDS + ADDED_KINDS
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
SERVICE_TOKEN = r"gh[pousr]_[A-Za-z0-9]{36,}"
SIGNED_TOKEN = r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}

RULE_VERSION = hashlib.sha256(repr([ASSIGN, ACCESS, HEX, PRIVATE_KEY, SERVICE_TOKEN, SIGNED_TOKEN, LEAST]).encode()).hexdigest()[:16]

_SCANNED = "sha binary, rule_version string"
_FINDINGS = "sha binary, rule_version string, kind string, start bigint, end bigint"

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A greedy run that is too short is dropped whole, which is the same as asking for the length in the pattern.
_runs = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "private_key": re.compile(PRIVATE_KEY),
    "service_token": re.compile(SERVICE_TOKEN),
    "signed_token": re.compile(SIGNED_TOKEN),
}
# A text without these holds no match of the kind.
_needed = {"access": b"AKIA", "private_key": b"PRIVATE KEY-----", "service_token": b"gh", "signed_token": b"eyJ"}
_words = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def find_secrets(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed."""
    low, as_text, found = text.lower(), text.decode("utf-8", "replace"), []
    if any(w in low for w in _words):
        found += [("assign", *m.span()) for m in _assign.finditer(as_text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in _runs.items():
        if kind not in _needed or _needed[kind] in text:
            found += [(kind, *m.span()) for m in pattern.finditer(as_text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def open_ledger(spark: SparkSession, folder: str) -> str:
    """Make an empty ledger in ``folder``, which must not hold one yet."""
    spark.createDataFrame([], _SCANNED).write.mode("append").parquet(f"{folder}/scanned")
    spark.createDataFrame([], _FINDINGS).write.mode("append").parquet(f"{folder}/findings")
    return folder


def _blobs(texts: DataFrame) -> DataFrame:
    """``sha, blob``: each content once per task, compressed."""

    def run(batches):
        seen, pack = set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for value in batch.column(0).cast(pa.binary()):
                text = value.as_py() or b""
                sha = hashlib.sha256(text).digest()
                if sha not in seen:
                    seen.add(sha)
                    rows.append((sha, pack.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["sha", "blob"])

    return texts.mapInArrow(run, "sha binary, blob binary")


def _scan(batches):
    """Findings of each blob; one row with a NULL kind marks the blob as scanned."""
    seen, unpack = set(), zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for sha, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if sha in seen:
                continue
            seen.add(sha)
            for row in [(None, None, None), *find_secrets(unpack.decompress(blob.as_py()))]:
                for column, value in zip(out, (sha, *row), strict=True):
                    column.append(value)
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["sha", "kind", "start", "end"])


def scan_history(paths: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what is new, extend the ledger, and return ``sha, kind, start, end`` of all blobs known to it."""
    spark = paths.sparkSession
    scanned = spark.read.schema(_SCANNED).parquet(f"{ledger}/scanned").filter(F.col("rule_version") == rule_version).select("sha")
    unseen = _blobs(paths.select(F.col(text).alias("text"))).repartition("sha").join(scanned, "sha", "left_anti")
    news = scratch(spark, "blobs")
    scans = unseen.mapInArrow(_scan, "sha binary, kind string, start bigint, end bigint")
    few_files(scans, paths.count()).write.parquet(news)
    fresh = spark.read.parquet(news).withColumn("rule_version", F.lit(rule_version))
    fresh.filter("kind is not null").select("sha", "rule_version", "kind", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    fresh.filter("kind is null").select("sha", "rule_version").write.mode("append").parquet(f"{ledger}/scanned")
    found = spark.read.schema(_FINDINGS).parquet(f"{ledger}/findings").filter(F.col("rule_version") == rule_version)
    return found.drop("rule_version").distinct()


def _joined(spans: str, base_only: bool) -> F.Column:
    kept = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS)) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blob_spans(findings: DataFrame) -> DataFrame:
    """``sha, spans``: the ordered spans of every blob with findings, as long as its text at most."""
    order = F.array_position(F.lit(KINDS), F.col("kind"))
    span = F.struct(F.col("start"), order.alias("nr"), F.col("kind"), F.col("end"))
    return findings.groupBy("sha").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def secret_digest(docs: DataFrame, ledger: str) -> DataFrame:
    """One row per document (path): counts by base kind, hash of the base spans, all spans."""
    spans = blob_spans(scan_history(docs, ledger))
    paths = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    found = spans.select(
        "sha", *[count(k) for k in BASE_KINDS], F.sha2(_joined("spans", True), 256).alias("base_sha256"), _joined("spans", False).alias("spans")
    )
    joined = paths.join(found, "sha", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: str, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; overlapping spans are replaced as one."""
    spans = blob_spans(scan_history(docs, ledger))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")
    # All columns of a document travel as one, so that names of any kind cannot clash.
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), sha).join(spans, "sha", "left")
    given = F.col("doc.text")
    # Walk the spans in order: text so far, and where the next plain piece begins.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, span):
        plain = F.substring(given, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        marked = F.when(span["start"] >= state["at"], F.concat(state["out"], plain, F.lit(mark))).otherwise(state["out"])
        return F.struct(marked.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(given, (s["at"] + 1).cast("int"), F.length(given))))
    changed = joined.select(F.col("doc").withField("text", F.when(F.col("spans").isNull(), given).otherwise(clean)).alias("doc"))
    if "n_chars" in docs.columns:
        changed = changed.select(F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)).alias("doc"))
    return changed.select("doc.*")
