"""Secret scans: spans from patterns, then corpus-wide ownership of each value.

One pass over the texts finds candidate spans and hashes their values. The hashes are aggregated by
distinct owners (``source``) and distinct repositories (documents). A value that :data:`EXAMPLE_OWNERS` owners or
:data:`EXAMPLE_REPOS` repositories have has been copied about and is an example from some manual or template; one that stays
with an owner or two, in few repositories, is taken for a live credential.
Values themselves never leave the scanning task; only their SHA-256 does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import free_name, split_by_key, stored

#: The three base kinds and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
BASE = ("assign", "access", "hex")
#: A run long enough is one match of HEX; asking for the length at once skips the short runs.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: Added kinds: publicly documented token prefixes and key blocks.
PREFIXED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", re.ASCII)
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.ASCII)
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KINDS = (*BASE, "prefixed", "jwt", "pem")
#: A value that so many owners or so many repositories have, or more, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 25
#: Hashes that one in so many spans has, or more, are handled apart.
HOT = 1000
MASK = "[SECRET]"

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())])
_SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,hash:binary>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def spans(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then kind in the order of :data:`KINDS`; null: none."""
    if not text:
        return []
    out = [Span("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [Span("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    if "_" in text or "-" in text or "AIza" in text:
        out += [Span("prefixed", m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text)]
    if "eyJ" in text:
        out += [Span("jwt", m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    if "-----BEGIN" in text:
        out += [Span("pem", m.start(), m.end(), m[0]) for m in PEM.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, base_sha256, spans and found (array of structs), a row for each row of ``docs``.

    Null and empty texts have no spans; repeated rows come back repeated; other columns are never read; an empty table gives an
    empty result.
    """
    src = docs.select(*(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("t"))
    kept = src.dtypes[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            base_sha, text_spans, structs = [], [], []
            for t in b.column(b.num_columns - 1):
                found = spans(t.as_py())
                base = [s for s in found if s.kind in BASE]
                for k, to in zip(BASE, counts, strict=True):
                    to.append(sum(s.kind == k for s in base))
                base_sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                text_spans.append(joined(found))
                structs.append([{"kind": s.kind, "start": s.start, "end": s.end, "hash": hashlib.sha256(s.value.encode("utf-8", "surrogatepass")).digest()} for s in found])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(base_sha, pa.string()), pa.array(text_spans, pa.string()), pa.array(structs, pa.list_(_SPAN))],
                names=[*b.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    ddl = ", ".join([f"k_{i} {t}" for i, (_, t) in enumerate(kept)] + ["n_assign long, n_access long, n_hex long, base_sha256 string, spans string", f"found {_SPAN_DDL}"])
    out = src.mapInArrow(run, ddl)
    return out.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_spans, n_repos, n_owners, live from rows (hash, repo, owner).

    Two levels of partial sums: a value that a third of the corpus holds costs a row for each task,
    and distinct counts come from rows that are distinct already. Null is an owner, and a repository, of its own.
    """
    owners = found.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("x")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("x").alias("n_spans"))
    repos = found.groupBy("hash", "repo").agg(F.count(F.lit(1)).alias("x")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    return owners.join(repos, "hash").withColumn("live", (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repos") < EXAMPLE_REPOS))


def _judged(scanned: DataFrame, uid: str, repo: str, owner: str) -> DataFrame:
    """uid, n_live, n_example, most_owners, most_repos and judged (array of start, end, kind, live) of rows with spans."""
    flat = scanned.filter(F.size("found") > 0).select(uid, F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode("found").alias("s"))
    flat = flat.select(uid, "repo", "owner", "s.kind", "s.start", "s.end", "s.hash")
    freq = stored(ownership(flat), "owners")
    # values of over a thousandth of all spans: a thousand at most, so they are broadcast, and no hot key is shuffled
    often = F.col("n_spans") > F.lit((freq.agg(F.sum("n_spans")).first()[0] or 0) / HOT)
    hot = freq.filter(often).drop("n_spans").withColumn("is_hot", F.lit(True))
    marked = flat.join(F.broadcast(hot), "hash", "left")
    rest = marked.filter("is_hot IS NULL").drop("n_owners", "n_repos", "live", "is_hot").join(freq.filter(~often).drop("n_spans"), "hash")
    rows = rest.unionByName(marked.filter("is_hot").drop("is_hot"))
    return rows.groupBy(uid).agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "live"))).alias("judged"),
    )


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of ``docs`` with its spans and how many look live or copied.

    Null and empty texts have no spans. Rows with a null id or owner take part (null is one owner of
    its own); repeated rows are judged alike and come back repeated; an empty table gives an empty
    result; other columns are never read. ``most_owners`` and ``most_repos`` are of the row's most copied value
    (0 without spans); ``n_live`` and ``n_example`` count spans by :func:`ownership`.
    """
    own, src = free_name(docs, "owner_"), docs
    src = src.withColumn(own, F.col(f"`{owner}`"))
    scanned = scan(src, text, (doc_id, own)).withColumnsRenamed({doc_id: "doc_id", own: "owner"})
    scanned = stored(scanned.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    seen = _judged(scanned, "uid", "doc_id", "owner")
    own_columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    counts = ("n_live", "n_example", "most_owners", "most_repos")
    plain = scanned.filter(F.size("found") == 0).select(*own_columns, *(F.lit(0).cast("long").alias(c) for c in counts))
    held = scanned.filter(F.size("found") > 0).join(seen, "uid").select(*own_columns, *counts)
    return plain.unionByName(held)


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with live-looking values masked in the text (and ``n_chars`` brought up to date).

    Copied examples and every other row stay as they are, null and empty texts too; repeated rows stay repeated. Overlapping
    live spans are masked as one. An empty table gives an empty result.
    """
    uid, live_ = free_name(docs, "uid"), free_name(docs, "live_")
    # the id is a hash of what the row holds, so equal rows get equal answers
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{owner}`"), F.col(f"`{text}`")).alias("h"))
    src = docs.withColumn(uid, key)
    # each row's spans are counted, as in secrets(); they are marked once for equal rows
    scanned = stored(scan(src, text, (uid, doc_id, owner)).filter(F.size("found") > 0).toDF("uid", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found").dropDuplicates(["uid"]), "redact")
    live = stored(_judged(scanned, "uid", "repo", "owner").filter("n_live > 0").select(F.col("uid").alias(uid), F.filter("judged", lambda x: x["live"]).alias(live_)), "live")
    plain, rest = split_by_key(src, live, uid)
    joined_ = rest.join(live, uid, "left")
    cut = F.aggregate(
        live_,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK)).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    new = F.when(F.col(live_).isNull(), F.col(f"`{text}`")).otherwise(cut)
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = joined_.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), F.col(live_).isNotNull().alias(live_))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(live_), F.length(f"`{text}`").cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"`{n_chars}`")))
    return plain.select(*names).union(out.select(*names))
