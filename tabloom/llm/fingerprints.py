"""Operator 3, document fingerprints: a canonical exact digest.

The canonical form of a text is its compatibility composition (NFKC), case-folded and composed again, with each run of
white space as one space and none at the ends. Its key is two 64-bit xxhash values under different seeds. Rows with
equal keys form a bucket, whose canonical texts are compared byte by byte; texts that differ in spite of equal keys get
different ordinals, in byte order. The fingerprint is the key in hex with the ordinal, so equal fingerprints mean equal
canonical texts, and likeness is 1.0 for these, else 0.0.

The next document in doc_id order comes from windows over ranges of doc_id: at most RANGES ranges (what the driver
holds), each with the first document of the range after it. Texts are shuffled once for that. Only texts whose key
occurs again are read a second time, to be compared.

All of it is DataFrame expressions; normalisation calls the ICU library that comes with Spark, through reflect().

Defined results: a null text is empty; the canonical form of an empty text is empty, and all of these share a
fingerprint; null doc_ids sort first; rows with equal doc_ids are ordered by text; a lone document is followed by
itself; very long texts are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow

#: Rows of a range, and the most ranges; beyond RANGES * ROWS rows ranges grow and spill.
ROWS, RANGES = 2048, 4096
_FINE = 64


def canonical(text: Column) -> Column:
    icu = lambda cls, method, x: F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))
    composed = lambda x: icu("text.Normalizer", "compose", x)
    folded = composed(icu("lang.UCharacter", "foldCase", composed(text)))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"(?U)\s+", " "))


def keys(canon: Column, name: str) -> list[Column]:
    return [F.xxhash64(canon).alias(f"{name}1"), F.xxhash64(F.lit("wide"), canon).alias(f"{name}2")]


def edited(text: Column, following: Column, n: Column) -> Column:
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - k).cast("int")), F.substring(following, F.lit(1), k))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are not above doc_id, by a coarse and a fine step; 0 for null."""
    at_or_below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + _FINE] for i in range(0, len(bounds), _FINE)]
    coarse = at_or_below(F.array(*[F.lit(g[0]) for g in groups]))
    fine = at_or_below(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse - 1))
    return F.when(doc_id.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * _FINE + fine)


def with_next(docs: DataFrame, rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """doc_id, t, next_id, next_t of docs(doc_id, t): each row with the one after it, the last with the first."""
    spark = docs.sparkSession
    n = min(ranges, max(1, -(-docs.count() // rows)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).head()[0] if n > 1 else []
    bounds = sorted({int(b) for b in bounds or []})
    ranged = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    firsts = sorted((r["range"], r["first"][0]) for r in ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect())  # a row per range
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    marks = F.broadcast(spark.createDataFrame(before, "first_id bigint, before int"))
    marked = ranged.join(marks, ranged["doc_id"].eqNullSafe(marks["first_id"]), "left").select(
        "doc_id", "t", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("extra")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))))).alias("in")
    ).select("doc_id", "t", "in.range", "in.extra")
    w = Window.partitionBy("range").orderBy("extra", F.asc_nulls_first("doc_id"), "t")
    return marked.select("doc_id", "t", "extra", F.lead(F.struct("doc_id", "t")).over(w).alias("after")).filter("not extra").select("doc_id", "t", F.col("after.doc_id").alias("next_id"), F.col("after.t").alias("next_t"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    full = with_next(docs).withColumn("n_chars", F.char_length("t").cast("bigint")).withColumn("e", edited(F.col("t"), F.col("next_t"), F.col("n_chars")))
    canon = full.select("doc_id", "next_id", "n_chars", F.xxhash64("t").alias("text_key"), F.xxhash64("next_t").alias("next_key"), F.sha2("e", 256).alias("edited_sha256"), canonical(F.col("t")).alias("c"), canonical(F.col("e")).alias("ec"), canonical(F.col("next_t")).alias("nc"))
    marks = cut(
        canon.select("doc_id", "next_id", "text_key", "next_key", "n_chars", "edited_sha256", *keys(F.col("c"), "k"), *keys(F.col("ec"), "e"), *keys(F.col("nc"), "n"), (F.col("c") == F.col("ec")).alias("same")),
        "fingerprint-marks",
    )
    clashes = _clashes(marks, docs)
    out = marks
    if clashes is not None:
        for role, by in (("k", ("doc_id", "text_key")), ("e", ("doc_id", "text_key", "next_key")), ("n", ("next_id", "next_key"))):
            ids = ("id", "text_key", "next_key")[: len(by)]
            own = clashes.filter(F.col("role") == ("e" if role == "e" else "k")).groupBy(*ids, "k1", "k2").agg(F.min("ordinal").alias(f"{role}_ordinal"))
            own = own.select(*[F.col(x).alias(f"c_{x}") for x in (*ids, "k1", "k2")], f"{role}_ordinal")
            on = (F.col(f"{role}1") == F.col("c_k1")) & (F.col(f"{role}2") == F.col("c_k2"))
            for x, y in zip(by, ids, strict=True):
                on &= F.col(x).eqNullSafe(F.col(f"c_{y}"))
            out = out.join(own, on, "left").drop(*own.columns[:-1])
        out = out.withColumn("e_ordinal", F.when(F.col("same"), F.col("k_ordinal")).otherwise(F.col("e_ordinal")))
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    ordinal = lambda role: F.coalesce(F.col(f"{role}_ordinal"), F.lit(0)).cast("string") if clashes is not None else F.lit("0")
    whole = lambda role: F.concat(part(f"{role}1"), part(f"{role}2"), F.lit("-"), ordinal(role))
    like = lambda a, b: (whole(a) == whole(b)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", whole("k").alias("fingerprint"), whole("e").alias("edited_fingerprint"), like("k", "e").alias("near_edited"), like("k", "n").alias("near_next"))


def _clashes(marks: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(id, text_key, next_key, role, k1, k2, ordinal) of rows in buckets whose canonical texts differ; None without any.

    A text is found again by its doc_id and its own key, as rows can share a doc_id. An edited text whose canonical bytes
    equal its own text's was compared in its row and need not be again.
    """
    who = ["doc_id", "text_key", "next_id", "next_key"]
    entries = marks.select(*who, "same", F.explode(F.array(F.struct(F.lit("k").alias("role"), "k1", "k2"), F.struct(F.lit("e").alias("role"), F.col("e1").alias("k1"), F.col("e2").alias("k2")))).alias("x")).select(*who, "x.*", "same").filter("role = 'k' or not same")
    again = entries.groupBy("k1", "k2").agg(F.count("*").alias("times")).filter("times > 1").select("k1", "k2")
    wanted = cut(entries.join(again, ["k1", "k2"]).select(*who, "role", "k1", "k2"), "fingerprint-again")
    edits = wanted.filter("role = 'e'")
    ids = wanted.select("doc_id", "text_key").unionByName(edits.select(F.col("next_id").alias("doc_id"), F.col("next_key").alias("text_key"))).distinct().select(F.col("doc_id").alias("want"), F.col("text_key").alias("want_key"))
    keyed = docs.withColumn("text_key", F.xxhash64("t"))
    found = keyed.join(narrow(ids, 2 * wanted.count()), keyed["doc_id"].eqNullSafe(F.col("want")) & (F.col("text_key") == F.col("want_key")), "left_semi")
    texts = found.groupBy("doc_id", "text_key").agg(F.min("t").alias("t"))
    own = texts.select(F.col("doc_id").alias("id"), "text_key", F.lit(None).cast("bigint").alias("next_key"), F.lit("k").alias("role"), canonical(F.col("t")).alias("c"))
    first = texts.select(F.col("doc_id").alias("id"), F.col("text_key").alias("own_key"), "t")
    second = texts.select(F.col("doc_id").alias("next"), F.col("text_key").alias("after_key"), F.col("t").alias("next_t"))
    both = edits.select(*who).distinct().join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("own_key"))).join(second, F.col("next_id").eqNullSafe(F.col("next")) & (F.col("next_key") == F.col("after_key")))
    changed = both.select("id", "text_key", "next_key", F.lit("e").alias("role"), canonical(edited(F.col("t"), F.col("next_t"), F.char_length("t"))).alias("c"))
    every = own.unionByName(changed).select("id", "text_key", "next_key", "role", "c", *keys(F.col("c"), "k"))
    # Least and greatest bytes of a bucket, gathered in each task first, so a hot bucket is a few rows.
    differ = cut(every.groupBy("k1", "k2").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("k1", "k2"), "fingerprint-clashes")
    if not differ.head(1):
        return None
    apart = every.join(differ, ["k1", "k2"])
    variants = apart.select("k1", "k2", "c").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("c")) - 1)
    return cut(apart.join(variants, ["k1", "k2", "c"]).select("id", "text_key", "next_key", "role", "k1", "k2", "ordinal"), "fingerprint-ordinals")
