"""Document fingerprints: SimHash over weighted word pairs, with DataFrame functions only.

The terms of a text are its pairs of neighbouring words (lower-cased, between
white space); a single word is a pair with nothing. A pair's weight is its number
of characters, 20 at most, times its occurrences. Each pair's 128 hash bits vote
with that weight; a fingerprint bit is set where the votes for it are more than
half of all. Two votes share a long, 32 bits each, so a text may have some
hundred million pairs.

Fingerprints within a Hamming radius are found through permuted block tables:
the bits fall into radius + 2 blocks, and any two fingerprints within the radius
agree on two blocks at least, so a table for each pair of blocks, keyed by them,
holds every match. Only distinct fingerprints go into the tables.

Null and empty texts, and texts of white space, have no votes: the fingerprint
is all zeros. Equal texts have equal fingerprints. Rows that share a doc_id are
one step in the order of ids, null comes before all others: the next document is
that of the next larger id, the text with the least xxhash64 where several rows
have it. A table with one id has itself as the next. Ids with more than 1 / MOST_HOT
of the rows are dealt out SALTS ways. Every join's plan is the same at all sizes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import stored, table

BITS = 128
#: Hamming radius of the search, and the longest pair that counts in full.
RADIUS, LONGEST = 6, 20
#: Ids that are dealt out at most, and the ways.
MOST_HOT, SALTS = 500, 64
#: Integer ids in one window when ids are put in order.
_WIDTH = 1 << 10


def following(ids: DataFrame, low: int, high: int) -> DataFrame:
    """(k, next_k) for distinct integers k between low and high; the last one's next is the first.

    Integers fall into ranges of _WIDTH, so that no window is larger than two of them; the ranges
    that have any are put in order in the same way.
    """
    last = high - low < 2 * _WIDTH
    bucket = (F.lit(0).cast("long") if last else F.shiftright("k", 10)).alias("bucket")
    each = ids.select("k", bucket).withColumn("then", F.lead("k").over(W.partitionBy("bucket").orderBy("k")))
    first = each.groupBy("bucket").agg(F.min("k").alias("first"))
    if last:
        return each.join(first, "bucket").select("k", F.coalesce("then", "first").alias("next_k"))
    order = following(first.select(F.col("bucket").alias("k")), low >> 10, high >> 10)
    after = order.join(first, order["next_k"] == first["bucket"]).select(F.col("k").alias("bucket"), F.col("first").alias("after"))
    return each.join(after, "bucket").select("k", F.coalesce("then", "after").alias("next_k"))


def _terms(text: str) -> Column:
    """The pairs of neighbouring words; a single word is a pair with the empty word, a blank text has the pair of empty words."""
    w = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    n = F.size(w)
    first = F.when(n > 1, F.slice(w, 1, n - 1)).otherwise(w)
    second = F.when(n > 1, F.slice(w, 2, n - 1)).otherwise(F.array(F.lit("")))
    return F.arrays_zip(first.alias("first"), second.alias("second"))


def _votes(hash_: str, prefix: str) -> list[Column]:
    """32 sums: the votes for bits k and k + 32, in the low and the high half of a long."""
    return [F.sum(F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(0x100000001)) * F.col("weight")).alias(f"{prefix}{k}") for k in range(32)]


def _word(prefix: str) -> Column:
    """The 64 bits that the votes give."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"{prefix}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{prefix}{k}", 32)
        for bit, votes in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.shiftleft((votes * 2 > F.col("total")).cast("long"), bit))
    return out


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of df but the text, with hi and lo, the fingerprint's 128 bits; together they must tell rows apart."""
    keys = [c for c in df.columns if c != text]
    terms = df.select(*keys, F.inline(_terms(text))).withColumn("weight", F.least(F.length("first") + F.length("second"), F.lit(LONGEST)).cast("long"))
    hashed = terms.select(*keys, "weight", F.xxhash64("first", "second").alias("h"), F.xxhash64("second", F.lit(1), "first").alias("g"))
    votes = hashed.groupBy(*keys).agg(F.sum("weight").alias("total"), *_votes("h", "h"), *_votes("g", "g"))
    return votes.select(*keys, _word("h").alias("hi"), _word("g").alias("lo"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Hamming distance of two fingerprints, given as (hi, lo)."""
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The cosine that the distance stands for, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * (3.141592653589793 / BITS)))


def _tables(df: DataFrame, hi: str, lo: str, radius: int) -> DataFrame:
    """(key, hi, lo) of each block table: the key tells the table and the bits of its two blocks."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]

    def block(k: int) -> list[Column]:
        parts, at = [], edges[k]
        while at < edges[k + 1]:
            end = min(edges[k + 1], 64 if at < 64 else 128)
            bits = F.shiftrightunsigned(hi if at < 64 else lo, at % 64)
            parts.append(bits if end - at == 64 else bits.bitwiseAND(F.lit((1 << (end - at)) - 1)))
            at = end
        return parts

    keys = [F.xxhash64(F.lit(i * n + j), *block(i), *block(j)) for i, j in combinations(range(n), 2)]
    return df.select(F.explode(F.array(*keys)).alias("key"), hi, lo)


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance) for every query (q_hi, q_lo) and every fingerprint (hi, lo) within the radius; both distinct."""
    d = distance(("q_hi", "q_lo"), ("hi", "lo"))
    tables = _tables(fps, "hi", "lo", radius).hint("merge")
    pairs = tables.join(_tables(queries, "q_hi", "q_lo", radius), "key").filter(d <= radius)
    return pairs.select("q_hi", "q_lo", "hi", "lo").distinct().withColumn("distance", d)


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, k, salt, row, next_k, n_chars, text, order and edited of every row; (k, salt, row) is unique.

    edited is the text with its last quarter of characters replaced by as many
    of the next document's first ones, or all that it has.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low - 1, high)
    key = F.coalesce("doc_id", F.lit(low)).cast("long").alias("k")
    sizes = docs.select(key, F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int").alias("need"))
    sizes = stored(sizes.groupBy("k").agg(F.max("need").alias("need"), F.count("*").alias("rows")), "sizes")
    least = max(1, (sizes.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT)
    hot = [r["k"] for r in sizes.filter(F.col("rows") > least).select("k").collect()]  # MOST_HOT ids at most
    # both joins read these columns and no others, so that one shuffle of the texts serves both
    d = docs.select(key, F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    d = d.withColumn("salt", F.when(F.col("k").isin(hot), F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int"))
    salts = lambda k: F.explode(F.when(F.col(k).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    asks = sizes.join(following(sizes.select("k"), low, high), "k").select(F.col("k").alias("asker"), "need", F.col("next_k").alias("k"))
    asked = d.hint("merge").join(asks.select("*", salts("k")), ["k", "salt"])
    head = F.struct(F.xxhash64("text").alias("order"), F.substring("text", F.lit(1), F.col("need")).alias("head"), "row")
    heads = asked.select("asker", F.col("k").alias("next_k"), head.alias("h")).groupBy("asker").agg(F.min("h").alias("h"), F.min("next_k").alias("next_k"))
    heads = heads.select(F.col("asker").alias("k"), "h.head", "next_k").select("*", salts("k"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.substring("head", F.lit(1), F.floor(n / 4).cast("int")))
    both = d.hint("merge").join(heads, ["k", "salt"])
    doc_id = F.when(F.col("k") != low, F.col("k")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return both.select(doc_id, "k", "salt", "row", "next_k", n.cast("long").alias("n_chars"), "text", F.xxhash64("text").alias("order"), edited.alias("edited"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_within: for ids divisible by 100, the other documents within RADIUS of the fingerprint."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    keys = ("doc_id", "k", "salt", "row", "next_k", "n_chars", "order", "edited_sha256")
    rows = edited_documents(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.array(*(F.struct(F.lit(w).alias("which"), F.col(c).alias("text")) for w, c in enumerate(("text", "edited"))))
    fps = fingerprints(rows.select(*keys, F.explode(texts).alias("v")).select(*keys, "v.which", "v.text"))
    one = fps.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}{w}") for w in (0, 1) for c in ("hi", "lo")))
    f = stored(one.drop("salt", "row"), "fingerprints")
    then = f.groupBy(F.col("k").alias("next_k")).agg(F.min(F.struct("order", "hi0", "lo0")).alias("s")).select("next_k", F.col("s.hi0").alias("hi2"), F.col("s.lo0").alias("lo2"))
    distinct = f.groupBy(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")).agg(F.count("*").alias("n"))
    queries = f.filter("doc_id % 100 = 0").select(F.col("hi0").alias("q_hi"), F.col("lo0").alias("q_lo")).distinct()
    near = within(queries, distinct.select("hi", "lo")).join(distinct, ["hi", "lo"]).groupBy(F.col("q_hi").alias("hi0"), F.col("q_lo").alias("lo0")).agg((F.sum("n") - 1).alias("found"))
    hex_ = lambda w: F.lower(F.concat(F.lpad(F.hex(f"hi{w}"), 16, "0"), F.lpad(F.hex(f"lo{w}"), 16, "0")))
    asked = f.filter("doc_id % 100 = 0").join(near, ["hi0", "lo0"])
    out = f.filter("coalesce(doc_id % 100 != 0, true)").withColumn("found", F.lit(None).cast("long")).unionByName(asked).hint("merge").join(then, "next_k")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_(0).alias("fingerprint"),
        hex_(1).alias("edited_fingerprint"),
        likeness(("hi0", "lo0"), ("hi1", "lo1")).alias("near_edited"),
        likeness(("hi0", "lo0"), ("hi2", "lo2")).alias("near_next"),
        F.col("found").alias("n_within"),
    )
