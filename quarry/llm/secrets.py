"""Secret scan with corpus-wide ownership frequency.

Patterns find the base spans; a wider pattern finds token-like candidates outside them. Candidate values
are hashed and counted over the whole corpus by distinct owners and repositories. A value that many
owners hold is a copied example; a value of one owner in few repositories looks live. Base spans always
stay and get a verdict; a wider candidate becomes a span only if it looks live.

Defined cases: a null text is empty; documents without spans give empty strings; rows that repeat count
as one repository; a null owner is an owner of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialise

KINDS = ("assign", "access", "hex", "pem", "generic")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENTROPY = 3.5
SCAN = "row_tag long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start: long, rank: int, end: long, value: string>>"


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value), by start, then kind."""
    low, found = text.lower(), []
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def wider_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Token-like candidates that touch no base span."""
    found = [(m.start(), 3, m.end(), m[0]) for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    for m in _GENERIC.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _entropy(v) >= _ENTROPY:
            found.append((m.start(), 4, m.end(), v))
    starts = [b for b, _, _, _ in base]
    reach = list(accumulate((e for _, _, e, _ in base), max))
    # A span touches a base span if one of those that begin before its end reaches beyond its start.
    return [s for s in found if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[0]]


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per document with its counts, base digest and all candidates; values leave only as hashes."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_tag"), F.col(id_col).alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"),
    )
    fields = dict(rows.dtypes)

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in frame["text"]:
                text = text or ""
                base = base_spans(text)
                counts = Counter(s[1] for s in base)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(counts[k])
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                both = sorted(base + wider_spans(text, base))
                out["spans"].append([{"start": a, "rank": k, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()} for a, k, b, v in both])
            yield frame[["row_tag", "doc_id", "repo", "owner"]].assign(**out)

    schema = f"row_tag long, doc_id {fields['doc_id']}, repo string, owner string, " + SCAN.split(", ", 1)[1]
    return rows.mapInPandas(found, schema)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, live_repos: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    scanned = materialise(scan(docs, id_col, text_col, repo_col, owner_col))
    spans = scanned.select("row_tag", "repo", "owner", F.explode("spans").alias("s")).select("row_tag", "repo", "owner", "s.*")
    nowhere = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    owners = spans.select("value", nowhere("owner")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repos = spans.select("value", nowhere("repo")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repos"))
    held = spans.join(owners.join(repos, "value"), "value")
    live = (F.col("owners") < example_owners) & ((F.col("owners") == 1) | (F.col("repos") <= live_repos))
    kept = held.withColumn("live", live).where((F.col("rank") < 3) | F.col("live"))
    told = F.transform(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end"))),
        lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"]),
    )
    per_doc = kept.groupBy("row_tag").agg(
        F.array_join(told, ",").alias("told"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example")
    )
    return scanned.drop("spans").join(per_doc, "row_tag", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("told", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))
