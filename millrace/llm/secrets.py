"""Secrets: patterns propose credentials, their owners in the whole corpus tell examples from live ones.

A first pass over the texts proposes spans and digests what they hold; no value leaves it. Digests
are then counted over the corpus: by how many owners, and in how many of their repositories, a
value occurs. What several owners hold was copied from one place, a manual or a template, and is an
``example``. What one or two hold is their own: ``live`` if it looks random, ``weak`` otherwise.

Spans of the base kinds always stay and carry their class; what the other kinds propose stays
only if it is live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_parts, text_or_empty
from millrace.session import reliable_checkpoint

#: kind -> pattern; the value is the last group, or the match without one. Repeats are possessive
#: where a failure behind them could look back, so endless runs stay linear.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
ADDED = {
    "vendor": re.compile(r"(?:gh[pousr]_|xox[abprs]-|[sr]k_live_|AIza|glpat-)[A-Za-z0-9_-]{16,}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+"),
    "key": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]*+)-----END"),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"),
}
KINDS = (*BASE, *ADDED)
PLACEHOLDER = re.compile("example|sample|dummy|changeme|change_me|placeholder|your|xxxx|redacted|1234567", re.I | re.A)
WIDE_OWNERS = 3
LEAST_ENTROPY = 2.75
SALTS = 16
PART_CHARS = 2_000_000


def entropy(value: str) -> float:
    """Bits per character of the value's own characters."""
    return math.fsum(n / len(value) * math.log2(len(value) / n) for n in Counter(value).values()) if value else 0.0


def looks_live(value: str) -> bool:
    """Random enough for a credential and no placeholder."""
    return entropy(value) >= LEAST_ENTROPY and not PLACEHOLDER.search(value)


def _mixed(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isupper, value)) and any(map(str.islower, value))


def proposals(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of one text by start, then kind; ends exclusive, in code points.
    A proposal of the added kinds that touches one of an earlier kind is left out."""
    found = [(kind, m.start(), m.end(), m[m.lastindex or 0]) for kind, pattern in BASE.items() for m in pattern.finditer(text)
             if len(m[m.lastindex or 0]) >= LEAST[kind]]
    for kind, pattern in ADDED.items():
        taken, more = sorted((s, e) for _, s, e, _ in found), []
        at = 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or taken[at][0] >= m.end()) and (kind != "opaque" or _mixed(m[0])):
                more.append((kind, m.start(), m.end(), m[m.lastindex or 0]))
        found += more
    return sorted(found, key=lambda v: (v[1], KINDS.index(v[0])))


PROPOSED = "array<struct<kind:string,`from`:long,`to`:long,digest:binary,live:boolean>>"
PROPOSED_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("digest", pa.binary()),
                                     ("live", pa.bool_())]))


def with_proposals(docs: DataFrame, text: str, owner: str, repository: str) -> DataFrame:
    """id (of the row), doc_id, owner, repository, found (``PROPOSED``), n_ and digest of the base spans."""
    counts = [f"n_{kind}" for kind in BASE]

    def run(batches):
        for batch in batches:
            found, numbers, digests = [], [], []
            for texts in column_parts(batch.column(3), PART_CHARS):
                for value in texts:
                    spans = proposals(value)
                    base = [v for v in spans if v[0] in BASE]
                    numbers.append([sum(v[0] == kind for v in base) for kind in BASE])
                    digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
                    found.append([{"kind": k, "from": s, "to": e, "live": looks_live(v),
                                   "digest": hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=16).digest()}
                                  for k, s, e, v in spans])
            columns = [pa.array([n[i] for n in numbers], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(found, PROPOSED_ARROW), *columns, pa.array(digests, pa.string())],
                ["doc_id", "owner", "repository", "found", *counts, "base_sha256"])

    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
                       text_or_empty(text).alias("text"))
    kept = ", ".join(f"{c} long" for c in counts)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, owner string, repository string, "
                                f"found {PROPOSED}, {kept}, base_sha256 string").withColumn("id", F.monotonically_increasing_id())


def ownership(uses: DataFrame) -> DataFrame:
    """digest, owners, repositories of ``uses`` (digest, owner, repository): exact numbers of distinct
    owners, null being one, and of distinct (owner, repository). A digest that is everywhere is
    reduced before each shuffle to a row per task and group."""
    return uses.distinct().groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("held")) \
        .groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("held").alias("repositories"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:from:to,
    by from, then kind), and, in the order of spans, classes, owners and repositories; n_live, n_example.

    A null text is empty and has no spans; null owners are one owner; repeated rows are the same
    repository once and give repeated results; other columns are not looked at; an empty
    table gives no rows.
    """
    rows = reliable_checkpoint(with_proposals(docs, text, owner, repository))
    each = rows.select("id", "owner", "repository", F.posexplode("found").alias("at", "v")) \
        .withColumn("digest", F.col("v.digest")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    # what occurs in one repository only needs no count; the rest meets its uses in salted parts
    repeated = ownership(each.select("digest", "owner", "repository")).where("repositories > 1") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    example = F.col("owners") >= WIDE_OWNERS
    judged = each.join(repeated, ["digest", "salt"], "left").na.fill(1, ["owners", "repositories"]).select(
        "id", "at", F.col("v.kind").alias("kind"), F.concat_ws(":", "v.kind", "v.from", "v.to").alias("span"), "owners", "repositories",
        F.when(example, "example").when(F.col("v.live"), "live").otherwise("weak").alias("class"))
    spans = judged.where(F.col("kind").isin(*BASE) | (F.col("class") == "live")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("at", "span", "class", "owners", "repositories"))).alias("all"))

    def joined(field: str):
        return F.coalesce(F.array_join(F.transform("all", lambda v: v[field].cast("string")), ","), F.lit(""))

    def number(name: str):
        return F.coalesce(F.size(F.filter("all", lambda v: v["class"] == name)), F.lit(0)).cast("long").alias(f"n_{name}")

    return rows.drop("found", "owner", "repository").join(spans, "id", "left").select(
        "doc_id", *[f"n_{kind}" for kind in BASE], "base_sha256", joined("span").alias("spans"), joined("class").alias("classes"),
        joined("owners").alias("owners"), joined("repositories").alias("repositories"), number("live"), number("example"))
