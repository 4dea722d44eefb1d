"""Operator 11, ranked lexical search, term at a time with limited accumulators.

Documents are read once, for the number of their terms and the occurrences of those that items ask for; the counts over
all documents follow from that table. Then each task ranks its documents in blocks. For an item the lists of its terms
are taken from the rarest to the commonest. A document met in a list gets an accumulator, until the bounds of the lists
that remain, summed, are below the kth best partial score: no document without an accumulator can get into the result
then. Those that have one are still updated by every list, so their scores are exact. The k best of a task are ranked
again over all tasks.

Items are taken in groups with at most ITEM_TERMS pairs of an item and a term (an item with more is a group), so what
tasks are sent is bounded; each group reads the documents once.

Defined results: a null or empty text has no terms, and isn't a document of the collection, as is one of separators only;
an item without terms has no rows; rows that share an item_id are one item, with the terms of all; a null item_id is an
item; a null doc_id is passed on, and comes last among equal scores; repeated rows are documents of their own; a very long
text is read in pieces; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_CHARS, cut, slices

K = 20
#: Pairs of an item and a term that tasks are sent at once.
ITEM_TERMS = 200_000
#: Pairs of a document and a term in a block of documents.
BLOCK_PAIRS = 1 << 21
#: Tasks whose best documents are ranked together, before those of all are.
RANKED_TOGETHER = 256
#: Byte to byte: letters, digits and bytes of other characters stay, A-Z lower-cased; all else is blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term, as bytes."""
    found: Counter = Counter()
    text = text or ""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_CHARS and (m := _SEPARATOR.search(text, at + PIECE_CHARS)):
            end = m.start()
        found.update(text[at:end].encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split())
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n of each item."""

    def run(batches):
        for batch in slices(batches):
            rows = [(i, t.decode("utf-8", "surrogatepass"), n) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t, n in term_counts(text).items()]
            ids, terms, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["item_id", "term", "n"])

    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "item_id bigint, term string, n bigint").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def in_groups(terms: DataFrame, most: int = ITEM_TERMS) -> list[DataFrame]:
    """terms in groups of items, of at most most rows each where no single item has more."""
    sizes = terms.groupBy(F.xxhash64("item_id").alias("h")).agg(F.count("*").alias("n"))
    n = terms.count()
    groups = max(1, -(-n // most))
    while groups > 1 and sizes.groupBy(F.pmod("h", F.lit(groups))).agg(F.sum("n").alias("n"), F.count("*").alias("items")).filter(f"n > {most} and items > 1").limit(1).count():
        groups *= 2
    return [terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else terms for g in range(groups)]


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms, with repeats), and its terms with a number, as terms and tfs, of each document with a term."""

    def run(batches):
        asked = number.keys()
        for batch in slices(batches):
            doc_ids, ns, terms, tfs = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = term_counts(text)
                if found:
                    both = found.keys() & asked
                    doc_ids.append(doc)
                    ns.append(found.total())
                    terms.append([number[t] for t in both])
                    tfs.append([found[t] for t in both])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Lists of a block of documents: those of term t are at starts[t] to starts[t + 1] of docs and parts."""

    doc_ids: np.ndarray  # null ids as the greatest integer
    starts: np.ndarray
    docs: np.ndarray
    parts: np.ndarray  # what an occurrence count adds for each unit of weight
    bounds: np.ndarray  # the greatest part of each list

    @classmethod
    def of(cls, doc_ids: np.ndarray, n: np.ndarray, held: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, all_terms: int) -> Block:
        m = 100 - 25 + (25 * n * n_docs) // all_terms
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(len(doc_ids)), held)[order]
        tfs = tfs[order].astype(np.int64)
        parts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs])
        starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        bounds = np.zeros(n_terms, np.int64)
        there = np.flatnonzero(starts[1:] > starts[:-1])
        if len(there):
            bounds[there] = np.maximum.reduceat(parts, starts[there])
        return cls(doc_ids, starts, docs, parts, bounds)

    def best(self, terms: list[tuple[int, int]], k: int, least: int = 0) -> list[tuple[int, int]]:
        """(-score, doc_id) of the k best documents for (term, weight) from the rarest on. least: a score that k documents elsewhere have."""
        sums = np.zeros(len(self.doc_ids), np.int64)
        has = np.zeros(len(self.doc_ids), bool)
        limited = False
        left = sum(w * int(self.bounds[t]) for t, w in terms)
        for t, w in terms:
            a, b = self.starts[t], self.starts[t + 1]
            docs, added = self.docs[a:b], w * self.parts[a:b]
            if not limited and left < least:
                limited = True
            if not limited and has.sum() >= k:
                own = sums[has]
                limited = left < int(np.partition(own, len(own) - k)[len(own) - k])
            if limited:
                there = has[docs]
                docs, added = docs[there], added[there]
            else:
                has[docs] = True
            sums[docs] += added  # a document is once in a list
            left -= w * int(self.bounds[t])
        found = np.flatnonzero(has & (sums > 0) & (sums >= least))
        if len(found) > k:
            kth = np.partition(sums[found], len(found) - k)[len(found) - k]
            found = found[sums[found] >= kth]
        return sorted(zip((-sums[found]).tolist(), self.doc_ids[found].tolist(), strict=True))[:k]


def best_of_tasks(lists: DataFrame, items: dict, n_terms: int, n_docs: int, all_terms: int, k: int = K) -> DataFrame:
    """item, score, doc_id, part: the k best documents of each task. items: (term, weight) of each, from the rarest on."""
    none = np.iinfo(np.int64).max

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in items]

        def rank(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
            own = table.column("terms").combine_chunks().value_lengths().to_numpy()
            block = Block.of(table.column("doc_id").fill_null(none).to_numpy(), table.column("n").to_numpy(), own, flat("terms"), flat("tfs"), n_terms, n_docs, all_terms)
            for i, terms in enumerate(items):
                least = -best[i][-1][0] if len(best[i]) == k else 0
                best[i] = sorted(best[i] + block.best(terms, k, least))[:k]

        held, pairs = [], 0
        for batch in batches:
            for some in slices([batch], 1 << 14):
                held.append(some)
                pairs += len(some.column("terms").flatten())
                if pairs >= BLOCK_PAIRS:
                    rank(held)
                    held, pairs = [], 0
        if held:
            rank(held)
        rows = [(i, -s, None if d == none else d) for i, found in enumerate(best) for s, d in found]
        item, score, doc = zip(*rows, strict=True) if rows else ((), (), ())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64()), pa.array([part] * len(rows), pa.int32())], names=["item", "score", "doc_id", "part"])

    return lists.mapInArrow(run, "item int, score bigint, doc_id bigint, part int")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents; see the module for the defined cases."""
    spark = docs.sparkSession
    terms = cut(item_terms(items), "item-terms")
    out = None
    for group in in_groups(terms):
        rows = group.collect()  # ITEM_TERMS slim rows, or one item's
        vocabulary = sorted({r["term"] for r in rows})
        number = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}
        lists = cut(postings(docs, number), "postings")
        n_docs, all_terms = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the group
        own: dict = {}
        for r in rows:
            t = number[r["term"].encode("utf-8", "surrogatepass")]
            if t in df:
                own.setdefault(r["item_id"], []).append((df[t], t, r["n"] * weight(n_docs, df[t])))
        ids = list(own)
        best = best_of_tasks(lists, [[(t, w) for _, t, w in sorted(own[i])] for i in ids], len(vocabulary), n_docs, all_terms, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # Two steps, so that no task gets the best documents of all tasks.
        first = Window.partitionBy("item", F.floor(F.col("part") / RANKED_TOGETHER)).orderBy(*order)
        some = best.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
        last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
        found = last.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return out


ORACLE = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS all_terms FROM sizes
), norms AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // all_terms AS m FROM sizes, whole
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole
), item_terms AS (
  SELECT item_id, term, count(*) AS qn
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
