"""Secret scan by corpus-wide ownership frequency.

Each text gives candidate spans. The hashes of the candidate values are counted over the whole corpus by distinct
repositories and owners: a value that many owners hold is a copied example, one that a single owner (or few) holds and
that looks random is a live-looking credential.

Defined results: a null text is an empty one; a null owner or repository is one owner or repository of its own; repeated
rows each give a row; a text of any length is searched whole, one text at a time; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batches, cut_lineage, python_rows

#: Base kinds, in the order in which equal starts are listed; "generic" is the kind that the method adds.
KINDS = ("assign", "access", "hex", "generic")

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(_SPAN))])
_FOUND_DDL = "doc_id bigint, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<kind:int,start:bigint,end:bigint,value:string,random:boolean>>"


def _scanner():
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    access, hexa = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
    generic = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
    mixed = [re.compile(x) for x in ("[A-Z]", "[a-z]", "[0-9]")]

    def looks_random(value: str) -> bool:
        return len(set(value)) >= 8 and bool(mixed[2].search(value))

    def span(kind: int, start: int, end: int, value: str) -> dict:
        return {"kind": kind, "start": start, "end": end, "value": hashlib.sha256(value.encode()).hexdigest(), "random": looks_random(value)}

    def scan(text: str) -> list[dict]:
        out = [span(0, *m.span(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        out += [span(1, *m.span(), m[0]) for m in access.finditer(text) if len(m[0]) >= 20]
        out += [span(2, *m.span(), m[0]) for m in hexa.finditer(text)]
        taken = sorted((s["start"], s["end"]) for s in out)
        for m in generic.finditer(text):
            if all(x.search(m[0]) for x in mixed) and not any(a < m.end() and m.start() < b for a, b in taken):
                out.append(span(3, *m.span(), m[0]))
        return sorted(out, key=lambda s: (s["start"], s["kind"]))

    return scan


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = _scanner()

    def rows():
        for part in parts:
            for doc_id, text, owner, repo in python_rows(part):
                found = scan(text or "")
                base = [s for s in found if s["kind"] < 3]
                listed = ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in base)
                yield (doc_id, owner, repo, *(sum(s["kind"] == k for s in base) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest(), found)

    return batches(rows(), _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners): in how many repositories and with how many owners each candidate hash occurs."""
    held = found.select(F.explode("found.value").alias("value"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"))
    # One row for each value, repository and owner first, so that copies of a value don't meet in one task.
    return held.distinct().groupBy("value").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", example_owners: int = 3) -> DataFrame:
    """One row for each document: counts and digest of the base kinds, and all spans with their verdicts.

    A value is an ``example`` from ``example_owners`` owners or repositories on, else ``live`` if it looks random, else
    ``weak``. Candidates of the added kind are reported only where they are live.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    found = cut_lineage(picked.mapInArrow(_find, _FOUND_DDL))
    own = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    some = found.filter(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id())
    span = some.select("row", *own, F.explode("found").alias("s")).select("row", *own, "s.*")
    verdict = F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_owners), "example").when(F.col("random"), "live").otherwise("weak")
    judged = span.join(ownership(found), "value").withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
    # A document whose only candidates are dropped generic ones has no judged span; the left side keeps its row.
    listed = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("all"))
    text = F.expr("array_join(transform(all, x -> concat_ws(':', element_at(array('assign','access','hex','generic'), x.kind + 1), x.start, x.end)), ',')")
    count = lambda v: F.coalesce(F.expr(f"cast(size(filter(all, x -> x.verdict = '{v}')) as bigint)"), F.lit(0)).alias(f"n_{v}")
    full = some.select("row", *own).join(listed, "row", "left").select(*own, F.coalesce(text, F.lit("")).alias("spans"), *(count(v) for v in ("live", "example", "weak")))
    none = found.filter(F.size("found") == 0).select(*own, F.lit("").alias("spans"), *(F.lit(0).cast("bigint").alias(f"n_{v}") for v in ("live", "example", "weak")))
    return full.unionByName(none)
