"""Homomorphic multiset hash of a text's paragraphs, in SQL expressions only.

A text is cut into paragraphs, at white space that holds a line end, and these
into sentences; white space between pieces is dropped. Every paragraph hashes to a
wide vector and a text's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two:

* 4 strong lanes modulo 2**60 (240 bits of the paragraph's SHA-256),
* one count lane (the number of its sentences),
* 128 sign lanes modulo 2**16 (lane k adds bit k of two 64-bit hashes of each of
  its sentences), four lanes to a long.

So the order of paragraphs does not count, and a paragraph can be put in or taken
out by adding or subtracting its vector. The strong lanes tell multisets of
paragraphs apart; the others compare. Twice a sign lane less the count is a sum
of random signs, hence the mean square of the difference of two such vectors
estimates how many sentences the texts do not share: that gives a likeness, with a
deviation of about 0.09.

Defined results: a null text counts as empty; an empty text, or one of white
space only, has the zero vector; two such texts have likeness 1; texts that
differ only in the white space between paragraphs or in their order have equal
fingerprints; rows are never merged, so ties and repeated rows each give their
own row; an empty table gives no rows; extra columns are ignored; very long
texts are hashed whole, and a piece that repeats over 2**15 times in one may
wrap a sign lane, which blurs its likeness but not its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import materialize

#: White space that has a line end parts paragraphs.
PARAGRAPHS, BLANK = r"[\n\r]\s*", " \t\x0b\x0c"
#: White space that has a line end or stands behind a sentence end or table bar.
PIECES = r"\s(?:(?<=[\n\r])|(?<=[.!?|]\s))\s*"
PACKED, STRONG = 32, 4
#: One bit, and the low 16, in each of the two halves of a long.
_PAIR = (1 << 32) + 1
_HALVES = (0xFFFF << 32) + 0xFFFF
_MOD60 = (1 << 60) - 1


def _clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fingerprinted(df: DataFrame, text: str, out: str, pattern: str = PIECES, paragraphs: str = PARAGRAPHS) -> DataFrame:
    """df with out, array<bigint>: the count, 32 longs of sign lanes, 4 strong lanes of the column text.

    Each step is a projection of its own, so that pieces and hashes are computed
    once and not for every lane that uses them.
    """
    zero = F.lit(0).cast("bigint")
    cut = lambda by, blank: F.filter(F.transform(F.split(_clean(F.col(text)), by, -1), lambda p: F.trim(p, F.lit(blank))), lambda p: p != F.lit(""))
    own = df.withColumn("_pieces", cut(pattern, " "))
    own = own.withColumns({"_first": F.transform("_pieces", lambda p: F.xxhash64(p)), "_second": F.transform("_pieces", lambda p: F.xxhash64(F.lit(1), p))})
    own = own.withColumn("_sha", F.transform(cut(paragraphs, BLANK), lambda p: F.sha2(p, 256)))

    def sums(w: int) -> Column:
        """How many hashes have each bit, of both kinds, in fields of w bits: longs j hold bits j, j + w, ..."""
        ones = F.lit(sum(1 << at for at in range(0, 63, w)))
        each = lambda hashes, j: F.aggregate(hashes, zero, lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(ones))
        return F.array(*[each(hashes, j) for hashes in ("_first", "_second") for j in range(w)])

    def signs(w: int) -> Column:
        """The longs of sign lanes from sums(w)."""
        own = (1 << min(w, 16)) - 1
        both = F.lit((own << 32) + own)
        half = lambda at, i: F.shiftrightunsigned(F.element_at("_sums", at + i % w + 1), i // w * w).bitwiseAND(both)
        return F.array(*[half(0, i).bitwiseOR(F.shiftleft(half(w, i), 16)) for i in range(PACKED)])

    def by_size(make) -> Column:
        """Fields as narrow as the number of pieces allows: the narrower, the fewer sums; all give the same lanes."""
        n = F.size("_first")
        return F.when(n < 1 << 7, make(8)).when(n < 1 << 15, make(16)).otherwise(make(32))  # below the sign bit

    def strong(i: int) -> Column:
        word = lambda s: F.conv(F.substring(s, 1 + 15 * i, 15), 16, 10).cast("bigint")
        return F.aggregate("_sha", zero, lambda acc, s: (acc + word(s)).bitwiseAND(F.lit(_MOD60)))

    own = own.withColumn("_sums", by_size(sums)).withColumn("_strong", F.array(*[strong(i) for i in range(STRONG)]))
    vector = F.concat(F.array(F.size("_first").cast("bigint")), by_size(signs), "_strong")
    return own.withColumn(out, vector).drop("_pieces", "_first", "_sha", "_second", "_sums", "_strong")


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def half(x: Column, y: Column) -> Column:
        """Both 16-bit fields of the masked halves, added or subtracted without borrowing from each other."""
        both = x + y if sign > 0 else x + F.lit((1 << 48) + (1 << 16)) - y
        return both.bitwiseAND(F.lit(_HALVES))

    def one(i: int) -> Column:
        x, y = F.element_at(a, i + 1), F.element_at(b, i + 1)
        if i == 0:
            return x + y * F.lit(sign)
        if i > PACKED:
            return F.pmod(x + y * F.lit(sign), F.lit(1 << 60))
        low = half(x.bitwiseAND(F.lit(_HALVES)), y.bitwiseAND(F.lit(_HALVES)))
        upper = lambda z: F.shiftrightunsigned(z, 16).bitwiseAND(F.lit(_HALVES))
        return low.bitwiseOR(F.shiftleft(half(upper(x), upper(y)), 16))

    return F.array(*[one(i) for i in range(1 + PACKED + STRONG)])


def insert(vector: Column, pieces: Column) -> Column:
    """The fingerprint of a text once pieces with that fingerprint are added."""
    return _lanewise(vector, pieces, 1)


def delete(vector: Column, pieces: Column) -> Column:
    """The fingerprint of a text once pieces with that fingerprint are removed."""
    return _lanewise(vector, pieces, -1)


def as_text(vector: Column) -> Column:
    """The fingerprint as 16 hex digits a long."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _products(a: Column, b: Column) -> Column:
    """The sum over sign lanes of the product of both vectors' sums of signs, 2 x - m and 2 y - n."""
    m, n = F.element_at(a, 1), F.element_at(b, 1)
    zero, lanes = F.lit(0).cast("bigint"), 4 * PACKED
    lane = lambda x, at: F.shiftrightunsigned(x, 16 * at).bitwiseAND(F.lit(0xFFFF))
    pairs = F.arrays_zip(F.slice(a, 2, PACKED).alias("x"), F.slice(b, 2, PACKED).alias("y"))

    def total(of) -> Column:
        return F.aggregate(pairs, zero, lambda acc, p: acc + sum((of(p["x"], p["y"], k) for k in range(1, 4)), of(p["x"], p["y"], 0)))

    def signed(x: Column, count: Column, at: int) -> Column:
        return F.pmod(lane(x, at) * 2 - count + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15)  # the residue nearest to zero

    plain = total(lambda x, y, k: lane(x, k) * lane(y, k)) * 4 - (total(lambda x, y, k: lane(x, k)) * n + total(lambda x, y, k: lane(y, k)) * m) * 2 + m * n * lanes
    wrapped = total(lambda x, y, k: signed(x, m, k) * signed(y, n, k))
    return F.when((m < 1 << 15) & (n < 1 << 15), plain).otherwise(wrapped).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the shared pieces over all pieces, as estimated from a and b."""
    whole = _products(a, a) + _products(b, b)
    share = F.when(whole > 0, 2 * _products(a, b) / whole).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def following(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) for the distinct keys: the next in ascending order, the last one's the first.

    The keys are dealt by range, so that only the range heads meet in one task.
    """
    ranged = materialize(
        ids.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    heads = ranged.groupBy("part").agg(F.min(key).alias("head"))
    first = heads.agg(F.min("head").alias("first"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))
    inside = Window.partitionBy("part").orderBy(key)
    return (
        ranged.select(key, "part", F.lead(key).over(inside).alias("within"))
        .join(F.broadcast(heads), "part")  # a row for each shuffle partition
        .crossJoin(F.broadcast(first))  # one row
        .select(key, F.coalesce("within", "after", "first").alias("next_key"))
    )


def edited_fingerprints(docs: DataFrame, pattern: str = PIECES) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likenesses.

    The edited text is the text whose last floor(n/2) code points give way to
    the first as many of the next document's. A text is fingerprinted once and
    moves by doc_id once, and of the next one only its vector and the part that
    is put in. Rows that repeat a doc_id each give a row; as a next document such
    an id stands for its least prefix. A null doc_id has no next document: its
    edited text is the part kept, and its near_next compares with an empty text.
    """
    # The one exchange by doc_id serves both joins.
    every = fingerprinted(docs.select("doc_id", _clean(F.col("text")).alias("text")), "text", "v", pattern)
    own = every.where(F.col("doc_id").isNotNull())
    sizes = docs.select("doc_id", F.char_length(_clean(F.col("text"))).alias("n"))
    links = (
        following(docs, "doc_id")
        .join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
        .select(F.col("doc_id").alias("owner"), F.col("next_key"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    )
    head = F.struct(F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"), F.col("v"))
    heads = own.join(links, F.col("doc_id") == F.col("next_key")).select("owner", head.alias("next")).groupBy("owner").agg(F.min("next").alias("next"))
    n = F.char_length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int"))
    # A repeated doc_id may need less of the head than its longest row.
    head = F.substring(_clean(F.col("next.head")), F.lit(1), F.floor(n / 2).cast("int"))
    alone = every.where(F.col("doc_id").isNull()).withColumns({"owner": F.col("doc_id"), "next": F.lit(None).cast(heads.schema["next"].dataType)})
    joined = own.join(heads, F.col("doc_id") == F.col("owner"), "left").unionByName(alone)
    none = F.array_repeat(F.lit(0).cast("bigint"), 1 + PACKED + STRONG)
    joined = joined.select("doc_id", n.cast("bigint").alias("n_chars"), F.concat(kept, head).alias("edited"), "v", F.coalesce("next.v", none).alias("nv"))
    both = fingerprinted(joined, "edited", "e", pattern)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"),
        likeness(F.col("v"), F.col("nv")).alias("near_next"),
    )
