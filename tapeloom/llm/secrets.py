"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, table
from tapeloom.storage import cut

#: Base kinds in their listed order; group ``v`` is the value, ``least`` its shortest length.
#: Letters of the assignment's key are matched in either case, ASCII only.
KEYS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    least: int
    base: bool = True


KINDS = (
    Kind("assign", r"(?:" + "|".join(map(_either_case, KEYS)) + r""")["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", 6),
    Kind("access", r"(?P<v>AKIA[A-Z0-9]+)", 20),
    Kind("hex", r"(?P<v>[0-9a-f]+)", 24),
    # candidates: they count only if the corpus shows them to be one owner's
    Kind("bearer", r"[Bb]earer\x20+(?P<v>[A-Za-z0-9+/_.=-]+)", 16, False),
    Kind("jwt", r"(?P<v>eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 30, False),
    Kind("prefixed", r"(?P<v>(?:gh[pousr]|glpat|xox[abprs]|sk|pk|rk)[_-][A-Za-z0-9_-]+)", 20, False),
)

#: Words that a run of hex digits this short can never be; makes the scan skip ordinary letters.
_SCAN = {"hex": r"(?P<v>[0-9a-f]{24,})", "access": r"(?P<v>AKIA[A-Z0-9]{16,})"}


@dataclass(frozen=True)
class Ownership:
    """When a value is one owner's own, and when it is a widely copied example."""

    own_max_owners: int = 1
    example_min_owners: int = 3
    example_min_repos: int = 5
    min_entropy_bits: float = 2.5  #: per character; below it a value is a placeholder


def scan_text(text: str, compiled) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points: leftmost matches by kind that do not overlap, short ones dropped."""
    found = []
    for kind, pattern in compiled:
        found += [(kind.name, m.start(), m.end(), m["v"]) for m in pattern.finditer(text) if len(m["v"]) >= kind.least]
    order = {k.name: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def compiled_kinds():
    return [(k, re.compile(_SCAN.get(k.name, k.pattern))) for k in KINDS]


#: A value with more copies is joined by broadcast; there are never more of these than MAX_HOT.
HOT_COPIES, MAX_HOT = 10_000, 100_000

FOUND = "doc_id long, repo string, owner string, row long, spans array<struct<kind:string,start:int,end:int,digest:binary,entropy:double>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, repo, owner, text); values leave the task only as digests."""
    def scan(batches):
        import hashlib
        import math
        from collections import Counter

        import pyarrow as pa

        kinds = compiled_kinds()
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("entropy", pa.float64())])

        def entropy(v):
            return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())

        for b in slices(batches):
            spans = [
                [{"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).digest()[:16], "entropy": entropy(v)} for k, s, e, v in scan_text(t.as_py() or "", kinds)]
                for t in b.column(4)
            ]
            yield pa.record_batch([*b.columns[:4], pa.array(spans, pa.list_(span))], names=["doc_id", "repo", "owner", "row", "spans"])

    # the row number tells rows with equal ids apart
    rows = docs.select(F.col("doc_id").cast("long"), "repo", "owner", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(scan, FOUND)


def ownership(found: DataFrame, rules: Ownership = Ownership()) -> DataFrame:
    """(digest, owners, repos, copies, verdict) of every candidate value.

    Pairs of value and owner are reduced before they are counted, so a value
    that a third of all rows hold is summed up where it is read.
    """
    each = found.select("repo", "owner", F.explode("spans").alias("s"))
    # a null owner or repository counts as one
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    each = each.select("s.digest", "s.entropy", name("owner").alias("owner"), name("repo").alias("repo"))
    pairs = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("copies"), F.max("entropy").alias("entropy"))
    by_owner = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("copies").alias("copies"), F.max("entropy").alias("entropy"))
    # a repository belongs to one owner; so repositories add up over owners
    counts = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("copies").alias("copies"), F.max("entropy").alias("entropy"))
    example = (F.col("owners") >= rules.example_min_owners) | (F.col("repos") >= rules.example_min_repos) | (F.col("entropy") < rules.min_entropy_bits)
    verdict = F.when(example, "example").when(F.col("owners") <= rules.own_max_owners, "live").otherwise("shared")
    return counts.withColumn("verdict", verdict)


def with_counts(each: DataFrame, counts: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``each`` with the counts of its digest; values that very many rows hold never meet in one task.

    A value is hot if it has more than ``hot_copies`` copies and more than one
    in ``MAX_HOT`` of all, so there are fewer hot values than ``MAX_HOT``
    whatever the corpus; these are broadcast, the rest is joined by shuffle.
    """
    counts = cut(counts)
    copies = counts.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(hot_copies, copies // MAX_HOT)
    hot = counts.where(is_hot)
    if hot.isEmpty():
        return each.join(counts, "digest")
    rest = each.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts.where(~is_hot), "digest")
    return each.join(F.broadcast(hot), "digest").unionByName(rest)


def find_secrets(docs: DataFrame, rules: Ownership = Ownership()) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (kind, start, end, owners, repos, copies, verdict).

    ``docs`` has doc_id, repo, owner, text; other columns are ignored. Base
    kinds are returned with any verdict; other kinds only if they are live. A
    null text is empty and has no spans; a null owner or repository counts as
    one of its own. Repeated rows give repeated results and raise ``copies``,
    not ``owners``. An empty table gives no rows.
    """
    found = cut(candidates(docs))
    each = found.where(F.size("spans") > 0).select("row", "doc_id", F.explode("spans").alias("s"))
    each = with_counts(each.withColumn("digest", F.col("s.digest")), ownership(found, rules))
    base = F.col("s.kind").isin(*[k.name for k in KINDS if k.base])
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))]), F.col("s.kind"))
    span = F.struct(F.col("s.start").alias("start"), order.alias("order"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), base.alias("base"), "owners", "repos", "copies", "verdict")
    own = each.where(base | (F.col("verdict") == "live")).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    empty = F.array().cast(own.schema["found"].dataType)
    return found.select("row", "doc_id").join(own, "row", "left").select("doc_id", F.coalesce("found", empty).alias("spans"))


def _joined(spans):
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its documents of one language are a repository of that owner."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("repo"), F.col("source").alias("owner"), "text")
    found = find_secrets(docs)
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter("spans", lambda x: x["verdict"] == v)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("shared").alias("n_shared"),
        verdicts("example").alias("n_example"),
    )
