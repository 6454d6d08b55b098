"""Secret scans with corpus-wide ownership frequency.

Every text is scanned whole for candidates.  The candidates' values are hashed
and the hashes counted by distinct repository and owner over all documents.
A value of three owners, or of two in eight repositories, is a widely copied
example.  A value of one owner in fewer than eight repositories that looks random
is a live credential; in more it is a value of the owner's own boilerplate, which
gets no class and so stays hidden.  The scan keeps every base and vendor span
and adds one span of kind ``example`` or ``live`` around each value so classed.
The counts and the digest cover the base kinds only.

Nulls are empty texts.  A null owner or repository is an owner or repository of
its own.  Rows that repeat an id are separate documents.  An empty table gives an
empty result.  Only the named columns are read (the redactor passes all on).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from entwine.llm.common import Scratch, task

KINDS = ("assign", "access", "hex", "vendor", "example", "live")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the whole run, as for [0-9a-f]+
#: Candidates beyond the base kinds: public prefixes of vendors' keys.
_VENDOR = re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}")
_PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|dummy|xxxx|your[_-]", re.IGNORECASE)
#: A value of this many owners is an example; one owner fewer will do if it is in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 8
#: Least length and entropy (bits a character) of a live-looking value.
LIVE_LENGTH, LIVE_BITS = 16, 3.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of the base kinds by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """Long, mixed, of high entropy and no placeholder."""
    if len(value) < LIVE_LENGTH or _PLACEHOLDER.search(value):
        return False
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= LIVE_BITS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _span_text(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


# A span's value is [at, end); ``at`` differs from ``start`` in assignments only.
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("at", pa.int32())])
_CAND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())])
_FOUND = "uid long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:int,kind:int,end:int,at:int>>, cands array<struct<start:int,end:int,value:binary,live:boolean>>"


def _scan(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for cell in b.column(text_at):
                text = cell.as_py() or ""
                spans = base_spans(text)
                n = Counter(k for _, k, _, _ in spans)
                more = [(m.start(), 3, m.end(), m[0]) for m in _VENDOR.finditer(text)]
                cands = {(e - len(v), e): v for _, _, e, v in (*spans, *more)}
                rows.append(
                    (
                        uid, n[0], n[1], n[2], hashlib.sha256(_span_text(spans).encode()).hexdigest(),
                        [{"start": s, "kind": k, "end": e, "at": e - len(v)} for s, k, e, v in (*spans, *more)],
                        [{"start": s, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v)} for (s, e), v in sorted(cands.items())],
                    )
                )
                uid += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_CAND))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(text_at)] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def scan(documents: DataFrame, keep: list[str], owner: Column, repository: Column, text_col: str = "text") -> DataFrame:
    """A struct ``row`` of the columns ``keep`` and, per row: counts, ``base_sha256``, found ``spans`` and ``added`` spans of classes (start, kind, end, at).

    The candidates alone are shuffled: distinct (value, owner, repository) rows
    are counted per value after partial aggregation, and the class comes back by
    a join on the value, whose hot values AQE splits.
    """
    scratch = Scratch(documents.sparkSession, "secrets")
    # the caller's columns travel in a struct, so their names meet none of these
    src = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), owner.cast("string").alias("owner"), repository.cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    fields = src.schema.fields[:3]
    found_schema = StructType([*fields, *StructType.fromDDL(_FOUND).fields])
    found = scratch.put("found", src.mapInArrow(task(_scan(3, found_schema.fieldNames())), found_schema))
    cands = found.select("uid", "owner", "repo", F.explode("cands").alias("c")).select("uid", "owner", "repo", "c.*")
    held = cands.select("value", "owner", "repo").distinct()
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    owners = scratch.put("owners", owners)
    classed = cands.join(owners, "value")
    widely = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") == EXAMPLE_OWNERS - 1) & (F.col("repos") >= EXAMPLE_REPOSITORIES))
    own = (F.col("owners") == 1) & (F.col("repos") < EXAMPLE_REPOSITORIES) & F.col("live")
    kind = F.when(widely, F.lit(KINDS.index("example"))).when(own, F.lit(KINDS.index("live")))
    added = classed.withColumn("kind", kind).where(F.col("kind").isNotNull())
    added = added.groupBy(F.col("uid").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.col("start").alias("at")))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,at:int>>")
    out = found.join(added, found["uid"] == added["of"], "left")
    return out.withColumn("added", F.coalesce("added", none)).drop("of", "uid", "owner", "repo", "cands")


def secret_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """Per row: id, base counts, digest of the base spans, all spans, and how many of them are examples and live.

    Without a repository column a document is a repository of its own.
    """
    found = scan(documents, [id_col], F.col(owner_col), F.col(repository_col or id_col), text_col)
    spans = F.array_sort(F.concat("spans", "added"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("added", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        F.col("row").getField(id_col).cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), count("example").alias("n_example"), count("live").alias("n_live")
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """``documents`` with every secret starred out, but for values that are copied examples.

    A span is shown only if its whole value is an example, not for an example within it.
    All rows and columns stay, whatever their names, and so does the length of every text in code points.
    """
    columns = documents.columns
    found = scan(documents, columns, F.col(owner_col), F.col(repository_col or id_col), text_col)
    example = KINDS.index("example")
    shown = F.filter("added", lambda s: s["kind"] == example)
    hidden = F.concat("spans", F.filter("added", lambda s: s["kind"] != example))
    hidden = F.filter(hidden, lambda h: ~F.exists(shown, lambda s: (s["start"] == h["at"]) & (s["end"] == h["end"])))
    at = columns.index(text_col)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(0).flatten()
            texts = held[at].to_pylist()
            for i, spans in enumerate(b.column(1).to_pylist()):
                if spans and texts[i]:
                    t = list(texts[i])
                    for s in spans:
                        t[s["start"] : s["end"]] = "*" * (s["end"] - s["start"])
                    texts[i] = "".join(t)
            held[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(held, names=columns)

    return found.select("row", hidden.alias("hidden")).mapInArrow(task(star), documents.schema)
