"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

A paragraph (a line, split at \n) is hashed with SHA-256 to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors:

* 8 dense lanes modulo 2**32, the digest's words: equal sums mean equal multisets of paragraphs but for
  collisions of a 256-bit hash;
* LANES sparse lanes modulo 2**16: a paragraph adds +1 or -1 to one of them, picked by its digest.
  The cosine of two documents' sparse lanes (read as signed numbers) estimates how much of their
  paragraphs they share.

Sums commute, so order doesn't matter, `combine(a, b)` is the fingerprint of both documents' paragraphs together and
`combine(a, b, -1)` deletes b's: inserting or deleting paragraphs needs no other text.

Edge cases: null text is empty text, which has no paragraph and all lanes 0 (two of those are alike with 1, one
of them and another text with 0); a repeated line counts as often as it occurs; rows are computed each by
itself, so repeated rows, long texts and clashing columns make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

DENSE, LANES = 8, 128
_32, _16 = 1 << 32, 1 << 16


def _hex(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("long")


def lanes(text: Column) -> Column:
    """The sums of a text's paragraph vectors as array<long>: DENSE dense lanes, LANES sparse ones."""
    paragraphs = F.split(text, "\n")
    digests = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(paragraphs, lambda p: F.sha2(p, 256)))

    def dense(ds: Column) -> Column:
        zero = F.array_repeat(F.lit(0).cast("long"), DENSE)
        words = lambda d: F.array(*[_hex(d, 8 * i + 1, 8) for i in range(DENSE)])
        return F.aggregate(ds, zero, lambda acc, d: F.zip_with(acc, words(d), lambda a, b: (a + b) % _32))

    def sparse(ds: Column) -> Column:
        zero = F.array_repeat(F.lit(0).cast("long"), LANES)

        def add(acc: Column, d: Column) -> Column:
            at = (_hex(d, 1, 4) % LANES).cast("int")
            one = F.when(_hex(d, 5, 1) < 8, F.lit(1)).otherwise(F.lit(_16 - 1)).cast("long")
            return F.concat(F.slice(acc, 1, at), F.array((F.get(acc, at) + one) % _16), F.slice(acc, at + 2, LANES))

        return F.aggregate(ds, zero, add)

    return let(digests, lambda ds: F.concat(dense(ds), sparse(ds)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union (sign 1) of two multisets of paragraphs, or of the first without the second (-1)."""
    mod = lambda i: F.when(i < DENSE, F.lit(_32)).otherwise(F.lit(_16)).cast("long")
    added = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(added, lambda x, i: F.pmod(x, mod(i)))


def text_form(v: Column) -> Column:
    """Lanes as hex digits: 8 for a dense lane, 4 for a sparse one."""
    return F.lower(F.concat(*[F.array_join(F.transform(F.slice(v, start, n), lambda x: F.lpad(F.hex(x), width, "0")), "") for start, n, width in ((1, DENSE, 8), (DENSE + 1, LANES, 4))]))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two lanes arrays: 1 if they are equal, else the cosine of the sparse lanes."""
    signed = lambda v: F.transform(F.slice(v, DENSE + 1, LANES), lambda x: F.when(x >= _16 // 2, x - _16).otherwise(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, p: s + p)
    cosine = let(signed(a), lambda x: let(signed(b), lambda y: let(dot(x, x) * dot(y, y), lambda n: F.when(n > 0, dot(x, y) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0)))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)), 6))


def splits(ids: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that cut the ids into ranges of about equal numbers of rows."""
    found = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), 10 * n).alias("s")).first() if n > 1 else None
    return sorted(set(found.s)) if found and found.s else []


def bucket_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at most doc_id: first among every so many cuts, then between two of those."""
    if not cuts:
        return F.lit(0)
    every = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to one literal
    step = max(1, round(len(cuts) ** 0.5))
    coarse = F.split(F.lit(",".join(map(str, cuts[::step]))), ",").cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda s: s <= doc_id))
    return let(F.greatest(below(coarse) - 1, F.lit(0)) * step, lambda at: at + below(F.slice(every, at + 1, step)))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, next_text, edited: the last floor(n_chars / 2) code points replaced by as
    many first ones of the next document, in descending doc_id (null last; equal ids by text).

    Texts are shuffled once, to ranges of doc_id that an approximate percentile of the ids sets; the first
    document of each range goes to the range above too (and the very first to the last range), so every next document
    is in its predecessor's range."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = splits(docs.select("doc_id"), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = bucket_of(F.col("doc_id"), cuts)
    ranges = Window.orderBy("bucket")  # over one row a range
    heads = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    heads = heads.select("head", F.coalesce(F.lead("bucket").over(ranges), F.min("bucket").over(Window.partitionBy(F.lit(1)))).alias("above"))
    rows = texts.withColumn("bucket", bucket).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    place = lambda b, ghost: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"))
    places = F.when(F.col("above").isNull(), F.array(place(F.col("bucket"), False))).otherwise(F.array(place(F.col("bucket"), False), place(F.col("above"), True)))
    rows = rows.select("doc_id", "text", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("ghost"))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    return both.select("doc_id", "text", "n_chars", "next_text", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of each document, of its edited text, and their likenesses."""
    e = edited_texts(docs)
    own, other, after = lanes(F.col("text")), lanes(F.col("edited")), lanes(F.col("next_text"))
    e = e.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), own.alias("own"), other.alias("other"), after.alias("after"))
    return e.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM d
), e AS (
  SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n
), u AS (
  SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e
), h AS (
  SELECT doc_id, kind, sha256(p) AS h FROM (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS p FROM u WHERE t <> '')
), dense AS (
  SELECT doc_id, kind, string_agg(printf('%08x', v), '' ORDER BY i) AS s FROM (
    SELECT u.doc_id, u.kind, i, CAST(coalesce(sum(CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)), 0) % 4294967296 AS BIGINT) AS v
    FROM u CROSS JOIN (SELECT unnest(range(8)) AS i) LEFT JOIN h ON h.doc_id = u.doc_id AND h.kind = u.kind GROUP BY ALL) GROUP BY ALL
), lane AS (
  SELECT doc_id, kind, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 128 AS i,
         CAST(sum(CASE WHEN CAST('0x' || substr(h, 5, 1) AS BIGINT) < 8 THEN 1 ELSE 65535 END) % 65536 AS BIGINT) AS v
  FROM h GROUP BY ALL
), sparse AS (
  SELECT doc_id, kind, string_agg(printf('%04x', v), '' ORDER BY i) AS s FROM (
    SELECT u.doc_id, u.kind, r.i, coalesce(lane.v, 0) AS v
    FROM u CROSS JOIN (SELECT unnest(range(128)) AS i) r LEFT JOIN lane ON lane.doc_id = u.doc_id AND lane.kind = u.kind AND lane.i = r.i) GROUP BY ALL
), f AS (
  SELECT dense.doc_id, dense.kind, dense.s || sparse.s AS s FROM dense JOIN sparse ON dense.doc_id = sparse.doc_id AND dense.kind = sparse.kind
), sv AS (
  SELECT doc_id, kind, i, CASE WHEN v >= 32768 THEN v - 65536 ELSE v END AS v FROM lane
), norm AS (
  SELECT doc_id, kind, CAST(sum(v * v) AS BIGINT) AS n FROM sv GROUP BY ALL
), dot AS (
  SELECT a.doc_id, b.kind, CAST(sum(a.v * b.v) AS BIGINT) AS x FROM sv a JOIN sv b ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.kind = 0 AND b.kind > 0 GROUP BY ALL
), near AS (
  SELECT f.doc_id, g.kind, CASE WHEN f.s = g.s THEN 1.0
         ELSE round(least(1.0, greatest(0.0, coalesce(CASE WHEN n.n * m.n > 0 THEN coalesce(dot.x, 0) / sqrt(CAST(n.n * m.n AS DOUBLE)) END, 0.0))), 6) END AS c
  FROM f JOIN f g ON f.doc_id = g.doc_id AND f.kind = 0 AND g.kind > 0
  LEFT JOIN norm n ON n.doc_id = f.doc_id AND n.kind = 0 LEFT JOIN norm m ON m.doc_id = f.doc_id AND m.kind = g.kind
  LEFT JOIN dot ON dot.doc_id = f.doc_id AND dot.kind = g.kind
)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.s AS fingerprint, b.s AS edited_fingerprint,
       CAST(x.c AS DOUBLE) AS near_edited, CAST(y.c AS DOUBLE) AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN near x ON x.doc_id = e.doc_id AND x.kind = 1 JOIN near y ON y.doc_id = e.doc_id AND y.kind = 2
"""
