"""Secret scans with corpus-wide ownership frequency.

Candidates are found in whole texts; their values' hashes are counted by distinct repositories and
owners. A value of one owner only looks live, one that many owners hold is a copied example. Besides the
three base kinds, mixed-class random-looking tokens are candidates of kind `owned`; they are reported
only where their value looks live. With widely=True an example must be spread widely, equal texts counted once: over
EXAMPLE_OWNERS owners, EXAMPLE_REPOSITORIES repositories and EXAMPLE_TEXTS texts, or over COPIED_TEXTS texts anywhere.

Null and empty texts have no spans. A null owner or repository counts as one unnamed one. Rows with the
same doc_id are scanned apart. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Values that more owners hold are examples.
MAX_OWNERS = 1
#: What an example is spread over at least, if it must be spread widely.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, EXAMPLE_TEXTS = 4, 6, 10
#: Different texts that make a value an example even of one owner.
COPIED_TEXTS = 1000
#: Distinct characters that a token of kind `owned` has at least.
MIN_DISTINCT = 12

_TOKEN_BYTE = c.byte_table(lambda b: chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-"))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of all candidates, sorted."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    tokens = [m for m in TOKEN.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for t in tokens for m in HEX.finditer(text, t.start(), t.end()) if len(m[0]) >= 24]
    taken = [(a, b) for a, _, b, _ in out]
    for t in tokens:
        x = t[0]
        if len(set(x)) >= MIN_DISTINCT and any(ch.isdigit() for ch in x) and any(ch.islower() for ch in x) and any(ch.isupper() for ch in x) and not any(a < t.end() and t.start() < b for a, b in taken):
            out.append((t.start(), 3, t.end(), x))
    return sorted(out)


def _joined(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: base counts and digest, owner, repository, and all candidates with value hashes."""
    c.small_batches(docs.sparkSession)
    repo = F.concat_ws("/", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in repository))
    rows = docs.select("doc_id", "text", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), repo.alias("repository"), F.xxhash64("text").alias("same"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, owner string, repository string, same long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,value:long>>"
    names = ["doc_id", "owner", "repository", "same", "n_assign", "n_access", "n_hex", "base_sha256", "found"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.text_buffer(batch.column(1))
            n = len(offsets) - 1
            start, end = c.spans_of(_TOKEN_BYTE[data], offsets)
            long_run = np.zeros(n, bool)
            long_run[np.searchsorted(offsets, start[end - start >= 20], "right") - 1] = True
            counts, digests, found = np.zeros((3, n), np.int64), [nothing] * n, [[]] * n
            raw = data.tobytes()
            for i in range(n):
                text = raw[offsets[i] : offsets[i + 1]]
                if not long_run[i]:
                    low = text.lower()
                    if not any(k in low for k in KEYWORDS):
                        continue
                every = candidates(text.decode())
                base = [x for x in every if x[1] < 3]
                for _, k, _, _ in base:
                    counts[k, i] += 1
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                found[i] = [{"start": a, "kind": k, "end": b, "value": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for a, k, b, v in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(found, kind)], names=names)

    return rows.mapInArrow(run, schema)


def ownership(candidate_rows: DataFrame) -> DataFrame:
    """value, owners, repositories, places: counted in steps that each combine before they shuffle."""
    by_repo = candidate_rows.groupBy("value", "owner", "repository").agg(F.count("*").alias("places"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"))


def _examples(places: DataFrame) -> DataFrame:
    """value and whether it is spread widely; equal texts count once, for their first owner and repository."""
    once = places.groupBy("value", "same").agg(F.min(F.struct("owner", "repository")).alias("first")).select("value", "first.*")
    spread = (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repositories") >= EXAMPLE_REPOSITORIES) & (F.col("places") >= EXAMPLE_TEXTS)
    return ownership(once).select("value", (spread | (F.col("places") >= COPIED_TEXTS)).alias("example"))


def secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, widely: bool = False) -> DataFrame:
    """Per document: counts, digest, spans (text) and marks, the reported spans with their verdicts."""
    scanned = c.staged(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    places = scanned.select("row", "owner", "repository", "same", F.explode("found").alias("f")).select("row", "owner", "repository", "same", "f.*")
    spread = ownership(places)
    spread = spread.join(_examples(places), "value") if widely else spread.withColumn("example", F.col("owners") > max_owners)
    salts = 16  # of one value that very many documents hold
    dealt = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("places") > 10_000, salts - 1).otherwise(0)))).withColumn("hot", F.col("places") > 10_000)
    marked = places.withColumn("salt", F.explode(F.array(F.lit(0), F.pmod("row", F.lit(salts - 1)).cast("int") + 1))).join(dealt, ["value", "salt"])
    marked = marked.where((F.col("salt") == 0) & ~F.col("hot") | (F.col("salt") > 0) & F.col("hot"))
    live = ~F.col("example")
    marked = marked.where((F.col("kind") < 3) | live).select("row", F.struct("start", "kind", "end", live.alias("live"), "owners", "repositories").alias("mark"))
    marks = marked.groupBy("row").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    names = F.array(*map(F.lit, KINDS))
    text = F.concat_ws(",", F.transform("marks", lambda m: F.concat_ws(":", F.element_at(names, m.kind + 1), m.start.cast("string"), m.end.cast("string"))))
    joined = scanned.join(marks, "row", "left").withColumn("marks", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)))
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"),
        F.size(F.filter("marks", lambda m: m.live)).cast("long").alias("n_live"), F.size(F.filter("marks", lambda m: ~m.live)).cast("long").alias("n_example"), "marks",
    )


def mask(text: str | None, spans: list[tuple[int, int]], with_: str = "[secret]") -> str | None:
    """The text with the given code-point spans, possibly overlapping, replaced."""
    if not text:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += (text[at:a], with_)
        at = max(at, b)
    return "".join([*out, text[at:]])
