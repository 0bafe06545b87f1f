"""Secret scans with an incremental blob ledger.

Every historical version of a text is a blob, named by its SHA-256. The ledger
is a table of (blob, rule_version) pairs that have been scanned, with their
findings. A scan hashes all versions, takes the pairs that the ledger lacks,
scans each such blob once, appends to the ledger, and joins the findings back
to every path (document, version) whose content is that blob.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, slices, whole_text

#: Base kinds in the order in which they are listed.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = re.compile(r"passw|secret|token|api", re.IGNORECASE | re.ASCII)
#: Rules that the method adds to the base ones: a literal that must occur, and the pattern.
ADDED = (
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("bearer", "Bearer ", re.compile(r"\bBearer [A-Za-z0-9._~+/-]{20,}=*")),
    ("pat", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
)
KIND_ORDER = {kind: k for k, kind in enumerate((*BASE_KINDS, *(x[0] for x in ADDED)))}
#: Changes with the rules, so that a ledger never serves findings of other rules.
RULE_VERSION = hashlib.sha256(repr([KIND_ORDER, ASSIGN.pattern, ACCESS.pattern, HEX.pattern, [(k, x, p.pattern) for k, x, p in ADDED]]).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, kinds array<string>, starts array<long>, ends array<long>"


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind as listed; code points, end exclusive."""
    found = []
    if (":" in text or "=" in text) and KEYWORDS.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, literal, pattern in ADDED:
        if literal in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KIND_ORDER[x[0]], x[2]))


class ScanTask:
    def __init__(self, rule_version: str):
        self.rule_version = rule_version

    def __call__(self, batch: pa.RecordBatch) -> dict:
        found = [find(t.as_py()) for t in batch.column(1)]
        pick = lambda k: [[x[k] for x in spans] for spans in found]
        return {"blob": batch.column(0), "rule_version": [self.rule_version] * len(found), "kinds": pick(0), "starts": pick(1), "ends": pick(2)}


def update(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, text_column: str = "text") -> DataFrame:
    """Scans the blobs that the ledger lacks for this rule version, appends them, and returns the findings: one row per blob that has any.

    Two writers may append the same blob; it counts once. Null texts count as empty.
    """
    spark = versions.sparkSession
    text = whole_text(text_column)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("__text"))
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version)
    if not known.isEmpty():
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    # min() of equal texts: the map side sends each blob of a partition once
    unseen = blobs.groupBy("blob").agg(F.min("__text").alias("__text"))
    map_arrow(unseen, lambda: ScanTask(rule_version), LEDGER).write.mode("append").option("compression", "zstd").parquet(ledger)
    return read_ledger(spark, ledger).where((F.col("rule_version") == rule_version) & (F.size("kinds") > 0)).drop("rule_version").dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Scans what the ledger (a folder, created if missing) lacks and returns one row per version: keys, blob, kinds, starts, ends.

    Null texts count as empty. Repeated rows and equal texts share one scan and
    each get the findings. Texts without findings have empty arrays. Spans are
    in code points of the whole text. Columns beyond keys and text are ignored; an
    empty table gives no row; keys named as the result's columns are not allowed.
    """
    findings = update(versions, ledger, rule_version, text_column)
    paths = versions.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("path"), F.sha2(whole_text(text_column), 256).alias("blob"))
    joined = paths.join(findings, "blob", "left")
    empty = {"kinds": "array<string>", "starts": "array<long>", "ends": "array<long>"}
    return joined.select(*[F.col(f"path.`{k}`") for k in keys], "blob", *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in empty.items()])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()'s rows."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    text = lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))
    is_base = lambda x: x["kinds"].isin(*BASE_KINDS)
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(F.filter(spans, is_base), text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(spans, text)).alias("spans"),
    )


def redacted(text: str, kinds: list[str], starts: list[int], ends: list[int], mark: str) -> str:
    """The text with each span, and each run of overlapping spans, replaced by one mark."""
    parts, at = [], 0
    for kind, start, end in zip(kinds, starts, ends):
        if start >= at:
            parts += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, mark: str = "[{}]") -> DataFrame:
    """The documents with every found span replaced by a mark of its kind; n_chars, if there, follows.

    Documents without findings come back as they are, null and empty texts too.
    Overlapping spans get one mark, of the first kind. Repeated rows and ids come
    back as often; an empty table stays empty; columns of any name are kept.
    """
    hits = update(docs.select("text"), ledger or fresh_path(docs.sparkSession, "ledger"), rule_version)
    columns, schema = docs.columns, docs.schema
    # columns by place, so that none of the documents' meets one of the findings'
    rows = docs.toDF(*[f"c{k}" for k in range(len(columns))]).withColumn("blob", F.sha2(whole_text(f"c{columns.index('text')}"), 256))
    joined = rows.join(hits, "blob", "left").drop("blob")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            arrays, spans = batch.columns[: len(columns)], batch.columns[len(columns) :]
            changed = spans[0].is_valid()
            if changed.true_count:
                # only texts with findings become Python strings
                at, found = columns.index("text"), [x.filter(changed).to_pylist() for x in spans]
                texts = [redacted(text, *of, mark) for text, *of in zip(arrays[at].filter(changed).to_pylist(), *found)]
                arrays[at] = pc.replace_with_mask(arrays[at], changed, pa.array(texts, type=arrays[at].type))
                if "n_chars" in columns:
                    at = columns.index("n_chars")
                    arrays[at] = pc.replace_with_mask(arrays[at], changed, pa.array(map(len, texts), type=arrays[at].type))
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(run, schema)
