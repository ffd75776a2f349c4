"""Document fingerprints from closed syncmers, in DataFrame operations only.

An anchor is a run of K characters whose smallest inner run of S characters, by hash, is its first or its last one.
Whether a run is an anchor depends on itself alone, so text that is moved or stands beside an edit keeps its anchors,
and those of an edited text follow from the kept part's and the new part's. A fingerprint holds the SIZE smallest
hashes of a text's anchors with their places. Two fingerprints are alike by the share of the smallest hashes of both
that both hold, at places that agree with the shift of most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, column, numbered, table

K, S, SIZE = 20, 5, 64
#: Inner runs of an anchor.
INNER = K - S + 1
#: Places agree if their shifts differ by this share of the longer reach at most, or by K.
SLACK = 0.125
#: An anchor is one number: 31 bits of hash, then a bit that is free, then its place in 31 bits.
PLACE, SIDE = (1 << 31) - 1, 1 << 31


def _no_anchors() -> Column:
    return F.array().cast("array<bigint>")


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(PLACE).cast("long"))


def packed(hash64: Column, at: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash64, 33), 32).bitwiseOR(at.cast("long"))


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column) -> Column:
    """Every anchor of a text, by place (from 0). Characters are looked up in 4 bytes each, so that no
    lookup walks through the text; the smallest of INNER (a power of 2) hashes is the smaller of two halves'."""
    def run(code: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.substring(code, at * 4 + 1, F.lit(4 * n)))

    def both(h: Column, by: int) -> Column:
        """The smaller of each hash and the one `by` places on; at the end, of what is left."""
        return F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda x, y: F.least(x, y))

    def lowest(h: Column, reach: int, use) -> Column:
        """use(m), m being the smallest of reach hashes from each place on."""
        return use(h) if reach == 1 else lowest(h, reach // 2, lambda m: bind(both(m, reach // 2), use))

    def found(code: Column) -> Column:
        n = F.octet_length(code) / 4
        starts = lambda length: F.sequence(F.lit(0), (n - length).cast("int"))
        hashes = F.transform(starts(S), lambda i: run(code, i, S))
        # the smallest is at an edge if it is the smaller one of the edges
        at_edge = lambda m, e: F.filter(starts(K), lambda i: F.get(m, i) == F.get(e, i))
        closed = bind(hashes, lambda h: lowest(h, INNER, lambda m: bind(both(h, INNER - 1), lambda e: at_edge(m, e))))
        return F.when(n >= K, F.transform(closed, lambda i: packed(run(code, i, K), i))).otherwise(_no_anchors())

    return bind(F.encode(text, "UTF-32"), found)


def smallest(every: Column, text: Column) -> Column:
    """The SIZE smallest hashes of anchors, each at its first place. A text without anchors has one: all of it."""
    lone = F.when(F.length(text) > 0, F.array(packed(F.xxhash64(text), F.lit(0)))).otherwise(_no_anchors())
    distinct = lambda s: F.slice(F.filter(s, lambda x, i: (i == 0) | (hash_of(F.get(s, i - 1)) < hash_of(x))), 1, SIZE)
    return bind(every, lambda a: F.when(F.size(a) > 0, bind(F.sort_array(a), distinct)).otherwise(lone))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: of the SIZE smallest hashes in either fingerprint, the share that both have at places which agree."""
    # sorted together, a hash that both have is two neighbours, a's first
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(SIDE)))))

    def paired(s: Column) -> Column:
        """The SIZE smallest distinct hashes of both, each with the shift of its places, or null if one has it alone."""
        shift = lambda x, y: F.when(hash_of(x) == hash_of(y), (place_of(y) - place_of(x)).cast("int"))
        each = F.transform(s, lambda x, i: F.struct((hash_of(F.get(s, i - 1)) == hash_of(x)).alias("again"), shift(x, F.get(s, i + 1)).alias("shift")))
        return F.slice(F.filter(each, lambda x: ~F.coalesce(x["again"], F.lit(False))), 1, SIZE)

    def agreeing(shifts: Column) -> Column:
        farthest = lambda x: F.array_max(F.transform(x, place_of))
        slack = F.greatest(F.lit(float(K)), F.greatest(farthest(a), farthest(b)) * SLACK)
        middle = F.get(F.sort_array(shifts), F.shiftright(F.size(shifts), 1))
        return bind(F.struct(middle.alias("middle"), slack.alias("slack")), lambda m: F.size(F.filter(shifts, lambda x: F.abs(x - m["middle"]) <= m["slack"])))

    def share(pairs: Column) -> Column:
        shifts = F.filter(F.transform(pairs, lambda p: p["shift"]), lambda x: x.isNotNull())
        return bind(shifts, agreeing) / F.size(pairs)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(bind(bind(both, paired), share))


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: hexadecimal hash and place of each anchor."""
    return F.array_join(F.transform(fingerprint, lambda s: F.concat_ws(":", F.lower(F.hex(hash_of(s))), place_of(s).cast("string"))), ",")


def followers(docs: DataFrame) -> DataFrame:
    """id and next: of every distinct id the next smaller one, of the smallest the largest; longest: its longest text."""
    ids = docs.where("id is not null").groupBy("id").agg(F.max("n_chars").alias("longest"))
    placed = Saved(numbered(ids, "fingerprint-order", F.desc("id")), "fingerprint-order").df
    n = placed.count()
    after = placed.select(F.col("id").alias("next"), F.when(F.col("index") == 1, F.lit(n)).otherwise(F.col("index") - 1).alias("index"))
    return placed.join(after, "index").select("id", "longest", "next")


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint and edited_fingerprint (arrays of anchors), near_edited and near_next of
    every document: of its text, and of the text with its last third replaced by the beginning of the next document's.

    Edge cases: a null text is empty; an empty text has no anchors and is like empty ones only; a text without anchors
    has one, all of it; a null key has no next document, so nothing replaces its last third and near_next is 0; rows
    that share a key share the next document, which is that of the next smaller key, and of several rows with that key
    the one whose text has the smallest hash; a single document follows itself; an empty table gives an empty
    result; extra columns are ignored.
    """
    with Scope() as scope:
        body = F.coalesce(column(text), F.lit(""))
        base = docs.select(column(key).alias("id"), body.alias("text"))
        known = base.where("id is not null")
        order = Saved(followers(known.select("id", F.length("text").cast("long").alias("n_chars"))), "fingerprint-next").df
        # what each document needs of the next one, which is looked up among all texts; both joins take the texts as they
        # are, so that they share one exchange
        wanted = order.select(F.col("id").alias("before"), F.col("next").alias("next_id"), F.floor(F.col("longest") / 3).cast("int").alias("need"))
        heads = known.join(wanted, F.col("id") == F.col("next_id")).select("before", F.xxhash64("text").alias("version"), F.col("next_id").alias("next"), F.left("text", F.col("need")).alias("head"))
        heads = heads.groupBy("before").agg(F.min(F.struct("version", "next", "head")).alias("h"))
        met = known.join(heads, F.col("id") == F.col("before"), "left").select("id", "text", "h")
        alone = base.where("id is null").select("id", "text", F.lit(None).cast(met.schema["h"].dataType).alias("h"))
        met = met.unionByName(alone).withColumn("n_chars", F.length("text").cast("long"))
        cut = F.floor(F.col("n_chars") / 3).cast("int")
        met = met.select("id", "text", F.xxhash64("text").alias("version"), "n_chars", (F.col("n_chars").cast("int") - cut).alias("stay"), F.coalesce(F.left("h.head", cut), F.lit("")).alias("come"), "h.next", F.col("h.version").alias("next_version"))
        # runs that reach into the new part begin among the last K - 1 characters that stay
        seam = F.greatest(F.col("stay") - (K - 1), F.lit(0))
        met = met.withColumn("edited", F.concat(F.left("text", F.col("stay")), "come")).withColumn("seam", seam)
        met = met.withColumn("own", anchors(F.col("text"))).withColumn("new", anchors(F.substring("edited", F.col("seam") + 1, F.lit((1 << 31) - 1))))
        old = F.filter("own", lambda x: place_of(x) + K <= F.col("stay"))
        moved = F.transform("new", lambda x: x + F.col("seam"))
        met = met.withColumn("fingerprint", smallest(F.col("own"), F.col("text"))).withColumn("edited_fingerprint", smallest(F.concat(old, moved), F.col("edited")))
        out = met.select("id", "version", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "next", "next_version")
        out = Saved(out, "fingerprint-own").df
        # equal texts have equal fingerprints, so any row of that key and version will do
        others = out.groupBy(F.col("id").alias("next"), F.col("version").alias("next_version")).agg(F.first("fingerprint").alias("after"))
        met = out.join(others, ["next", "next_version"], "left")
        near = F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(likeness(F.col("fingerprint"), F.col("after")))
        return scope.result(met.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near.alias("near_next")), "fingerprint-result")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprinted(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", written(F.col("fingerprint")).alias("fingerprint"), written(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
