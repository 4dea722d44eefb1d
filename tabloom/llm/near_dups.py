"""Operator 8, near duplicates: MinHash with banding, verification of signatures and then of full sets, components.

1. Each text gives its set's size, a digest of its word sequence, band keys and a signature. Texts with equal digests
   have equal sets: one row of them, the representative (the least doc_id), goes on.
2. Representatives with equal band keys are candidates. Each is held against its bucket's least representative, never
   all against all: first the signatures, then the full sets, which are made anew from the texts.
3. Links give components. In a bucket that still has several components, pairs across them are compared in pairs of
   blocks, without making rows of them: first by signatures alone; then full sets are sent to a pair of blocks for those
   members only that have a partner there whose signature agrees. What comes out is links that connect. That closes
   every candidate pair, however a bucket is made up.

At 24 bands of 5 rows a pair with a similarity of 0.85 shares no band with a probability of 8e-7, one of 0.8 with 7e-5;
the signatures lose far less (see SLACK). A full set holds 64-bit hashes of shingles, which are made of 64-bit hashes of
words: two different shingles of a table are taken for one with a probability of 5e-20 per pair.

Defined results: null and empty texts and those without words have an empty set and no links; a null doc_id is linked
with nothing, has a null component_id and is kept; rows with equal doc_ids are one document for links and each gives a
row; very long texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import forget
from .common import cut, narrow, slices
from .components import components
from .shingles import HASHES, band_keys, linked, minima, sets_of

#: Members that are held against a leader under one salt, and members and shingles of a block of a large bucket, about.
GROUP, BLOCK, BLOCK_SHINGLES = 256, 2048, 1 << 22
#: How far a link's estimate may lie below the threshold. Of pairs right at it the binomial tail over 120 minima falls
#: further with a probability of 1.5e-8 at 0.85 and 1.5e-7 at 0.8, which is little beside that of sharing no band.
SLACK = 0.2


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, bands, signature (low 16 bits) of each text; the last three null without words."""

    def run(batches):
        forget()
        for batch in slices(batches):
            n, digests, bands, signatures = [], [], [], []
            for words, shingles in sets_of(batch.column("text").to_pylist()):
                n.append(len(shingles))
                if not len(shingles):
                    digests.append(None), bands.append(None), signatures.append(None)
                    continue
                signature = minima(shingles)
                digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature))
                signatures.append(signature.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of signatures agree in a share of at least least."""
    return (a == b).sum(1) >= least * HASHES


def _close(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of pairs (leader, member), those whose signatures agree enough."""
    signature = reps.select(F.col("rep").alias("member"), F.col("signature").alias("member_signature"))
    leaders = reps.select(F.col("rep").alias("leader"), F.col("signature").alias("leader_signature"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("member_signature", "leader_signature"))
            yield batch.select(["leader", "member"]).filter(pa.array(_alike(a, b, least)))

    return pairs.join(signature, "member").join(leaders, "leader").select("leader", "member", "member_signature", "leader_signature").mapInArrow(run, "leader bigint, member bigint")


def _linked(pairs: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """Of pairs (leader, member), those whose full sets link, from the texts. A hot leader's members are dealt out."""
    pairs = cut(pairs, f"{name}-pairs")
    many = pairs.groupBy("leader").agg(F.count("*").alias("members"))
    salted = pairs.join(many, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("members") / GROUP)).alias("salt"))
    wanted = cut(
        salted.select("leader", "salt", F.col("member").alias("doc"), F.lit(1).alias("place")).unionByName(salted.select("leader", "salt", F.col("leader").alias("doc"), F.lit(0).alias("place")).distinct()),
        f"{name}-wanted",
    )
    texts = docs.join(narrow(wanted, wanted.count()), docs["doc_id"] == wanted["doc"]).select("leader", "salt", "place", "doc", "text")
    dealt = texts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "place", "doc")

    def run(batches):
        own: list[np.ndarray] = []  # of the leader: more than one only where rows share its doc_id
        group = None
        for batch in slices(batches):
            found_leader, found_member = [], []
            for leader, salt, place, doc, (_, shingles) in zip(*(batch.column(c).to_pylist() for c in ("leader", "salt", "place", "doc")), sets_of(batch.column("text").to_pylist()), strict=True):
                if group != (leader, salt):
                    group, own = (leader, salt), []
                if not place:
                    own.append(shingles)
                elif len(shingles) and any(len(x) and linked(x, shingles, percent) for x in own):
                    found_leader.append(leader)
                    found_member.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(found_leader, pa.int64()), pa.array(found_member, pa.int64())], names=["u", "v"])

    return cut(dealt.mapInArrow(run, "u bigint, v bigint"), f"{name}-links")


def _sets(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, shingles) of the representatives in reps, as bytes."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([x.tobytes() for _, x in sets_of(batch.column("text").to_pylist())], pa.binary())], names=["rep", "shingles"])

    wanted = cut(reps.select("rep").distinct(), "open")
    return cut(docs.join(narrow(wanted, wanted.count()), docs["doc_id"] == wanted["rep"]).select("rep", "text").mapInArrow(run, "rep bigint, shingles binary"), "open-sets")


class _Block:
    """The members of one pair of blocks of a bucket, and which pairs among them are to be compared there."""

    def __init__(self, group: tuple, rows: list[tuple], percent: int, least: float):
        self.band, self.inside = group[1], group[2] == group[3]
        self.own, self.reps, self.comps, self.sizes = (np.array([r[i] for r in rows]) for i in range(4))
        self.signatures = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, HASHES)
        self.bands = np.array([r[5] for r in rows])
        self.percent, self.least = percent, least

    def partners(self, i: int) -> np.ndarray:
        """The later members that may link with member i, by all but the full sets."""
        j = np.arange(i + 1, len(self.reps))
        # Pairs inside a block are compared in the group of that block alone.
        j = j[(self.comps[j] != self.comps[i]) & (True if self.inside else self.own[j] != self.own[i])]
        a, b = np.minimum(self.sizes[j], self.sizes[i]), np.maximum(self.sizes[j], self.sizes[i])
        j = j[100 * a >= self.percent * b]
        if len(j):
            j = j[_alike(self.signatures[j], self.signatures[i][None], self.least)]
        if len(j):
            # A pair with several common buckets is compared in that of its first band.
            j = j[(self.bands[j] == self.bands[i]).argmax(1) == self.band]
        return j


def _with_partner(group: tuple, rows: list[tuple], percent: int, least: float):
    """The members that have a partner in their group, each as (key, band, a, b, rep)."""
    block, found = _Block(group, rows, percent, least), np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        j = block.partners(i)
        found[j] = True
        found[i] |= len(j) > 0
    return [(*group, int(r)) for r in block.reps[found]]


def _links_across(group: tuple, rows: list[tuple], percent: int, least: float):
    """Links across components in one group, by full sets; a link spares the pairs that it connects."""
    block, sets = _Block(group, rows, percent, least), [np.frombuffer(r[6], np.uint64) for r in rows]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    got = []
    for i in range(len(rows) - 1):
        for k in block.partners(i).tolist():
            x, y = root(int(block.comps[i])), root(int(block.comps[k]))
            if x != y and linked(sets[i], sets[k], percent):
                parent[max(x, y)] = min(x, y)
                got.append((int(block.reps[i]), int(block.reps[k])))
    return got


def _by_group(rows: DataFrame, columns: list[str], work, schema: dict[str, pa.DataType]) -> DataFrame:
    """work(group, rows) over the rows of each (key, band, a, b), in the order of rep."""
    by = ["key", "band", "a", "b"]

    def run(batches):
        group, held = None, []

        def out(got):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True) if got else [()] * len(schema), schema.values(), strict=True)], names=list(schema))

        for batch in slices(batches):
            got = []
            for *g, row in zip(*(batch.column(c).to_pylist() for c in by), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if g != group:
                    if group:
                        got += work(tuple(group), held)
                    group, held = g, []
                held.append(row)
            yield out(got)
        if group:
            yield out(work(tuple(group), held))

    dealt = rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, "rep")
    return dealt.mapInArrow(run, ", ".join(f"{n} {'int' if t == pa.int32() else 'bigint'}" for n, t in schema.items()))


def _rest(buckets: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (u, v) across the components of buckets with several of them, among pairs that no leader was part of."""
    placed = buckets.join(found, buckets["rep"] == found["node"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component")).join(reps.select("rep", "n_shingles"), "rep")
    open_keys = placed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("size"), F.min("rep").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).filter("members > 2 and low < high")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    left = cut(placed.join(open_keys.select("key", "first", blocks.alias("blocks")), "key").filter("rep <> first").drop("first"), "open-buckets")
    dealt = (
        left.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "component", "n_shingles")
        .join(reps.select("rep", "signature", "bands"), "rep")
    )
    columns = ["own", "rep", "component", "n_shingles", "signature", "bands"]
    with_partner = cut(_by_group(dealt, columns, lambda g, rows: _with_partner(g, rows, percent, least), {"key": pa.int64(), "band": pa.int32(), "a": pa.int32(), "b": pa.int32(), "rep": pa.int64()}), "open-members")
    few = dealt.join(with_partner, ["key", "band", "a", "b", "rep"]).join(_sets(with_partner, docs), "rep")
    return cut(_by_group(few, [*columns, "shingles"], lambda g, rows: _links_across(g, rows, percent, least), {"u": pa.int64(), "v": pa.int64()}), "rest-links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = cut(sketches(docs), "sketches")
    usable = known.filter("doc_id is not null and digest is not null")
    reps = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "reps")
    entries = reps.select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("top")).filter("leader < top").select("key", "leader")
    buckets = cut(entries.join(shared, "key").select("key", "band", "rep", "leader"), "buckets")
    least = percent / 100 - SLACK
    pairs = buckets.filter("rep <> leader").select("leader", F.col("rep").alias("member")).distinct()
    signed = reps.select("rep", "n_shingles", "signature", "bands")
    links = _linked(_close(pairs, signed, least).distinct(), docs, percent, "near")
    # Rows that share a doc_id are one document: it is linked with the representatives of all its texts.
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("doc_id")
    same = cut(usable.select("doc_id", "digest").join(several, "doc_id").join(reps.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "same-id")
    links = links.unionByName(same)
    found = components(links, "near-edges")
    more = _rest(buckets.select("key", "band", "rep"), found, signed, docs, percent, least)
    if more.head(1):
        found = components(links.unionByName(more), "near-edges")
    by_digest = reps.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = known.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
