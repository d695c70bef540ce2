"""Operator 1: secret scan over an incremental ledger of blobs.

Every historical version of a file is a row (path, version, text). Its content address is the SHA-256 of its text, so
equal contents are one blob wherever and whenever they occur. The ledger has a row for each (blob, rule version) that was
ever scanned, with the findings; a scan reads only the pairs that the ledger lacks, and findings are joined back to all
paths and versions of a blob.

Null texts count as empty, empty texts have no findings, null paths are paths like any other, repeated rows are returned
as often as they come, columns besides those named are ignored and not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ship

#: Of the rules below; a rule that changes needs a new number, so that old blobs are scanned again.
RULE_VERSION = "3"
BASE = ("assign", "access", "hex")
#: Fixed patterns. The first three are the base; the others are the scan's own.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MORE = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "url": re.compile(r"(?<=[a-z0-9+.-])://[^\s/:@]+:[^\s/:@]{3,}@"),  # from the colon on; the scheme is before it
}
SCHEME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
KINDS = (*BASE, *MORE)
#: HEX and ACCESS, as runs that are long enough; the runs are maximal either way.
LONG_HEX, LONG_ACCESS = re.compile(r"[0-9a-f]{24,}"), re.compile(r"AKIA[A-Z0-9]{16,}")
FINDINGS = "array<struct<kind:string,start:int,stop:int>>"
SCANNED = f"blob binary, rule_version string, findings {FINDINGS}"


def scheme(text: str, end: int) -> int:
    """Where the scheme that ends there starts: at the first small letter of the run of its characters."""
    start = end
    while start and text[start - 1] in SCHEME_CHARACTERS:
        start -= 1
    while start < end and not "a" <= text[start] <= "z":
        start += 1
    return start


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of KINDS."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in LONG_ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    if "gh" in text:
        out += [("github", *m.span()) for m in MORE["github"].finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in MORE["jwt"].finditer(text)]
    if "-----BEGIN" in text:
        out += [("pem", *m.span()) for m in MORE["pem"].finditer(text)]
    if "://" in text:
        out += [("url", start, m.end()) for m in MORE["url"].finditer(text) if (start := scheme(text, m.start())) < m.start()]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        found = [[dict(zip(("kind", "start", "stop"), x, strict=True)) for x in find(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([RULE_VERSION] * b.num_rows, pa.string()), pa.array(found, kind)], names=["blob", "rule_version", "findings"])


def blob_id(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for the blobs of versions that the ledger lacks under RULE_VERSION.

    Copies of a blob meet in a partial aggregate before the shuffle, so a blob with very many copies costs one row a task.
    """
    ship(versions.sparkSession)
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).mapInArrow(_scan, SCANNED)


def findings_by_path(versions: DataFrame, ledger: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and findings of every row of versions, from a ledger that covers them. Only blobs with findings are joined."""
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0)).select("blob", "findings")
    paths = versions.select(*keys, blob_id(F.col(text)).alias("blob"))
    return paths.join(hits, "blob", "left").select(*keys, F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def update_ledger(versions: DataFrame, ledger_path: str, text: str = "text") -> DataFrame:
    """Appends what is new to the Parquet ledger at ledger_path and returns the whole ledger."""
    spark = versions.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    old = spark.read.schema(SCANNED).parquet(ledger_path) if there else None
    scan_new(versions, old, text).write.mode("append").parquet(ledger_path)
    return spark.read.schema(SCANNED).parquet(ledger_path)


def report(paths: DataFrame) -> DataFrame:
    """Digest columns of rows (doc_id, findings)."""
    text = lambda x: F.concat_ws(":", x.kind, x.start, x.stop)
    base = F.filter("findings", lambda x: x.kind.isin(*BASE))
    count = lambda k: F.size(F.filter("findings", lambda x: x.kind == k)).cast("long")
    return paths.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("findings", text)).alias("spans"),
    )


def digest(text: str | None) -> tuple:
    """The digest of one text, by the rules as they are stated; for tests."""
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    spans.sort(key=lambda x: (x[1], BASE.index(x[0])))
    n = [sum(x[0] == k for x in spans) for k in BASE]
    return (*n, hashlib.sha256(",".join("%s:%d:%d" % x for x in spans).encode()).hexdigest())
