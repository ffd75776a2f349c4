"""Fuzzy line dedup in DataFrame operations only: SimHash of normalised lines, pigeonhole blocks, edit similarity.

Two lines are linked if their edit similarity is LIKENESS or more. A line's SimHash has a word of 64 bits that all its
features vote for, and blocks of 32 bits that only a share of them vote for, chosen by the feature's hash: some four to
sixteen features a block, whatever the line's length. So an edit leaves whole blocks as they are, and lines that
differ in few features meet in one of them (the README gives the measured recall); lines that meet and differ in
MAX_BITS of the whole line's bits at most are compared. Features are the distinct words of a line, of short ones their
character trigrams. Of each connected group of lines the first occurrence stays.

Votes are summed in 8-bit lanes of long columns over exploded features, in one aggregation that needs no exchange of
its own, since lines are dealt out before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, column, table
from chronoloom.llm.components import connected_components, with_component

#: Most bits of 64 by which the whole lines' SimHashes of candidates differ.
MAX_BITS = 24
LIKENESS = 0.9
#: Lines of less than GRAMS_BELOW words have trigrams as features, of WORDS_FROM or more words, those between both.
WORDS_FROM, GRAMS_BELOW = 16, 18
#: Blocks of a class. Classes of even and of odd number have blocks of their own.
BLOCKS = 4
#: The bits that choose a block's features are 16, so there is no class above this one and the next.
MOST_CLASSES = 15
#: Of pairs with a line above LONG, bounds on their edits are looked at first: by runs of RUN characters, and word by word.
LONG, RUN = 4096, 8
#: A word above this is not compared with another in the bound by words.
LONG_WORD = 64
#: Members of a block of a bucket, where a bucket's members meet in blocks.
BLOCK = 512
#: A line that has more than this share of all lines is joined by broadcast; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512
#: Characters that stand for words: the first one, and how many.
FIRST_CODE, CODES = 0x4E00, 20480
_LANES = 0x0101010101010101


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]++", " "))


def normalised_lines(text: Column) -> Column:
    """The normalised lines of a text. The text is looked through once, before it is cut, and single spaces, which most
    gaps between words are, stay as they are."""
    gap = r" *+[^\p{L}\p{N}\n ][^\p{L}\p{N}\n]*+|  ++"
    return F.transform(F.split(F.regexp_replace(F.lower(text), gap, " "), "\n"), lambda line: F.trim(line))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, version (tells texts of one key apart), n, line and id of each line. Lines without a letter or digit are
    empty and no lines to compare."""
    parts = docs.where(column(key).isNotNull()).select(column(key).alias("doc"), F.xxhash64(column(text)).alias("version"), F.posexplode(normalised_lines(column(text))).alias("n", "line"))
    return parts.withColumn("id", F.xxhash64("line"))


def featured(lines: DataFrame) -> DataFrame:
    """id, kind (0: trigrams, 1: words), size (characters) and features (hashes, distinct) of lines (id, line)."""
    # characters in 4 bytes each, so that no trigram is looked for from the line's beginning
    starts = lambda code: F.sequence(F.lit(0), F.greatest((F.octet_length(code) / 4).cast("int") - 3, F.lit(0)))
    grams = F.transform(F.array(F.encode("line", "UTF-32")), lambda code: F.transform(starts(code), lambda i: F.xxhash64(F.substring(code, i * 4 + 1, F.lit(12)))))[0]
    words = F.split("line", " ")
    cut = lines.select("id", "line", F.length("line").alias("size"), words.alias("words"))
    few, many = F.size("words") < GRAMS_BELOW, F.size("words") >= WORDS_FROM
    kinds = F.array(F.when(few, F.struct(F.lit(0).alias("kind"), grams.alias("f"))), F.when(many, F.struct(F.lit(1).alias("kind"), F.transform("words", lambda w: F.xxhash64(w)).alias("f"))))
    each = cut.select("id", "size", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return each.select("id", F.col("k.kind").alias("kind"), "size", F.array_distinct("k.f").alias("features"))


def bits(sums: list[Column], total: Column) -> Column:
    """The bits with more than half of the total votes (127 at most); the k-th of the sums has, in 8-bit lanes, the votes
    for bits k, k + 8, .... In 16-bit lanes, bit 14 is set where sum + 2^14 - 1 - half has it."""
    lanes, top = 0x00FF00FF00FF00FF, F.lit(0x4000400040004000)
    add = ((1 << 14) - 1 - F.shiftright(total, 1)) * F.lit(0x0001000100010001)
    each = [F.shiftleft(F.shiftrightunsigned((F.shiftrightunsigned(v, 8 * part).bitwiseAND(F.lit(lanes)) + add).bitwiseAND(top), 14), 8 * part + k) for k, v in enumerate(sums) for part in (0, 1)]
    return reduce(lambda x, y: x.bitwiseOR(y), each)


def simhash(lines: DataFrame) -> DataFrame:
    """id, size, sim and bucket: a row for each bucket of signatures()."""
    return signatures(lines).select("id", "size", "sim", F.explode("buckets").alias("bucket"))


def signatures(lines: DataFrame) -> DataFrame:
    """id, kind, size, sim (64 bits) and buckets: a row for each line and kind of its features, and a bucket for each block
    that has votes of three features, or of all.

    A class c has the features whose hash is divisible by 2^c, block by block with bits of their own; a line of n
    features is in the classes in which four to eight, and eight to sixteen, are to be expected. So two lines with
    about as many features share one class at least. Of lines of 64 features and more, sim takes a share, too, of 32 to
    64 features, so that no lane overflows.
    """
    sized = featured(lines.repartition("id")).withColumn("n", F.size("features"))
    low = F.least(F.greatest(F.floor(F.log2(F.col("n") / 8)), F.lit(0)), F.lit(MOST_CLASSES)).cast("int")
    # the even class, and the odd one, of the two; a line of less than eight features is in class 0 alone
    even, odd = low + F.pmod(low, F.lit(2)), F.when(F.col("n") >= 8, low + 1 - F.pmod(low, F.lit(2))).otherwise(-1)
    sized = sized.withColumn("even", even).withColumn("odd", odd).withColumn("whole", F.greatest(low - 2, F.lit(0)))
    keys = ["id", "kind", "size", "even", "odd"]
    voters = sized.select(*keys, "whole", F.explode("features").alias("h"))
    voters = voters.withColumn("m0", F.xxhash64("h", F.lit(1))).withColumn("m1", F.xxhash64("h", F.lit(2)))
    vote = [F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) for k in range(8)]
    share = lambda c: F.expr(f"shiftleft(1L, greatest({c}, 0)) - 1")
    inside = [F.shiftrightunsigned(m, 16 * b).bitwiseAND(share(c)) == 0 for m, c in (("m0", "even"), ("m1", "odd")) for b in range(BLOCKS)]
    within = F.xxhash64("h", F.lit(3)).bitwiseAND(share("whole")) == 0
    some = lambda test, v: F.sum(F.when(test, v).otherwise(F.lit(0).cast("long")))
    sums = [some(within, v).alias(f"v{k}") for k, v in enumerate(vote)] + [some(i, vote[k]).alias(f"b{b}_{k}") for b, i in enumerate(inside) for k in range(4)]
    counted = voters.groupBy(*keys).agg(*sums, F.count_if(within).alias("n"), *(F.count_if(i).alias(f"n{b}") for b, i in enumerate(inside)))
    every = counted.withColumn("sim", bits([F.col(f"v{k}") for k in range(8)], F.col("n")))

    def bucket(b: int) -> Column:
        """Null where the block has too few votes to tell lines apart. Four sums have 32 bits."""
        c = "even" if b < BLOCKS else "odd"
        hashed = bits([F.col(f"b{b}_{k}") for k in range(4)], F.col(f"n{b}"))
        # lanes hold bits k, k + 8, ...: 4 of every 8; the place of the block, its class and the kind go between
        tag = ((F.col(c) * (2 * BLOCKS) + b) * 2 + F.col("kind")).cast("long")
        spread = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(F.shiftrightunsigned(tag, 4 * i).bitwiseAND(F.lit(15)), 8 * i + 4) for i in range(3)))
        # class 0 has all features in each of its blocks, so that one will do
        enough = F.col(c) == 0 if b == 0 else F.lit(False)
        return F.when(enough | (F.col(c) > 0) & (F.col(f"n{b}") >= 3), hashed.bitwiseOR(spread))

    return every.select("id", "kind", "size", "sim", F.array_compact(F.array(*map(bucket, range(2 * BLOCKS)))).alias("buckets"))


def kind_of(bucket: Column) -> Column:
    """The kind of the features that a bucket is of, which is the lowest bit of its tag."""
    return F.shiftrightunsigned(bucket, 4).bitwiseAND(F.lit(1))


def shared_buckets(hashed: DataFrame) -> DataFrame:
    """bucket, id, n (members of the bucket), size and sim of what signatures() gives, of buckets with two members or more.

    All buckets are dealt out once, both for their sizes and for the join with these (either side reads the same columns
    of the same rows, none of which is null), and without SimHashes, which few members need: most buckets have one."""
    members = hashed.select("id", F.explode("buckets").alias("bucket")).where("id is not null and bucket is not null").repartition("bucket")
    sizes = members.groupBy("bucket").agg(F.count("id").alias("n")).where("n > 1")
    sims = hashed.select(F.col("id").alias("__id"), F.col("kind").alias("__kind"), "size", "sim")
    met = members.join(sizes, "bucket")
    return met.join(sims, (F.col("id") == F.col("__id")) & (kind_of(F.col("bucket")) == F.col("__kind"))).select("bucket", "id", "n", "size", "sim")


def alike() -> Column:
    """Of a pair with sizes and SimHashes x and y: near enough to be compared."""
    longer = F.greatest("x_size", "y_size")
    return (F.bit_count(F.col("x_sim").bitwiseXOR(F.col("y_sim"))) <= MAX_BITS) & (F.abs(F.col("x_size") - F.col("y_size")) <= F.floor(longer * (1 - LIKENESS) + 1e-9))


def coded(words: Column) -> Column:
    """A string with one character for each word, chosen by the word's hash."""
    codes = F.transform(words, lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(CODES)) + FIRST_CODE))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def runs_of(line: Column) -> Column:
    """The hashes of a line's runs of RUN characters, by place."""
    # characters in 4 bytes each, as in featured()
    starts = lambda code: F.sequence(F.lit(0), F.greatest((F.octet_length(code) / 4).cast("int") - RUN, F.lit(0)))
    return F.transform(F.array(F.encode(line, "UTF-32")), lambda code: F.transform(starts(code), lambda i: F.xxhash64(F.substring(code, i * 4 + 1, F.lit(4 * RUN)))))[0]


def lacking(a: Column, b: Column, most: Column) -> Column:
    """How many runs of a (see runs_of) b lacks, where `most` edits move a run by as many places at most."""
    about = lambda runs, near: F.transform(runs, lambda r, i: F.xxhash64(r, F.floor(i / most) + near))
    return F.size(F.array_except(about(a, 0), F.concat(*(about(b, k) for k in (-1, 0, 1)))))


def edits_by_words(a: Column, b: Column) -> Column:
    """No less than the edits between two lines: those of the words at one place, with what one line has beyond the other."""
    size = lambda x: F.coalesce(F.length(x), F.lit(-1))
    most = lambda x, y: F.greatest(size(x), size(y))
    word = lambda x, y: F.when(x == y, 0).when(x.isNull() | y.isNull(), most(x, y) + 1).when(most(x, y) > LONG_WORD, most(x, y)).otherwise(F.levenshtein(x, y))
    return F.aggregate(F.zip_with(F.split(a, " "), F.split(b, " "), word), F.lit(0), lambda n, k: n + k)


def comparable(lines: DataFrame) -> DataFrame:
    """id, line, and what edit_links needs of a line besides, of lines (id, line)."""
    return lines.select("id", "line", coded(F.split("line", " ")).alias("coded"), F.when(F.length("line") > LONG * LIKENESS - 1, runs_of(F.col("line"))).alias("runs"))


def trimmed(a: Column, b: Column) -> Column:
    """The two lines without the words that they begin and end with alike: as many edits lie between these (x and y) as
    between the lines. Each word goes with a space behind it, so that words alone come and go."""

    def cut(words: Column) -> Column:
        x, y = words["x"], words["y"]
        alike_ = lambda p, q: F.coalesce(F.array_position(F.zip_with(p, q, lambda v, w: F.coalesce(v == w, F.lit(False))), False) - 1, F.lit(-1))
        least = F.least(F.size(x), F.size(y))
        ahead = lambda n: F.when(n < 0, least).otherwise(n).cast("int")
        first = F.transform(F.array(ahead(alike_(x, y))), lambda n: F.struct(n.alias("n"), F.least(ahead(alike_(F.reverse(x), F.reverse(y))), least - n).alias("m")))
        rest = lambda w, at: F.transform(F.slice(w, at["n"] + 1, F.size(w) - at["n"] - at["m"]), lambda v: F.concat(v, F.lit(" ")))
        return F.transform(first, lambda at: F.struct(F.array_join(rest(x, at), "").alias("x"), F.array_join(rest(y, at), "").alias("y")))[0]

    return F.transform(F.array(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))), cut)[0]


def edit_links(near: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of line ids whose edit similarity is LIKENESS or more. lines are those of comparable(), or have
    id and line."""
    if "coded" in lines.columns:
        return _edit_links(near, lines)
    texts = Saved(comparable(lines), "line-texts")
    out = _edit_links(near, texts.df)
    texts.drop()
    return out


def _edit_links(near: DataFrame, texts: DataFrame) -> DataFrame:
    """As edit_links. The cost of edits grows with the square of a line. So lines lose what they begin and end with
    alike. Of long lines, an edit spoils RUN runs at most, so that a pair that lacks more runs is none; where edits at
    equal places are few enough, it is one; the edits of what is left are counted as of other lines, whatever that takes."""
    side = lambda a: texts.select(F.col("id").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in ("line", "coded", "runs")))
    long = F.greatest(F.length("a_line"), F.length("b_line"))
    met = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").withColumn("__most", F.floor(long * (1 - LIKENESS) + 1e-9).cast("int")).where("abs(length(a_line) - length(b_line)) <= __most").withColumn("__long", long).withColumn("__cut", trimmed(F.col("a_line"), F.col("b_line")))
    # edits of words, where they are few, say how wide a band of characters is worth a try before the whole one
    words = F.expr("levenshtein(a_coded, b_coded, length(a_coded) div 10 + 1)")
    tried = lambda pairs: pairs.withColumn("__try", F.expr("least(__most, if(__words >= 0, 5 * __words + 2, 0))"))
    by_edits = F.expr("greatest(length(__cut.x), length(__cut.y)) <= __most or (__try > 0 and levenshtein(__cut.x, __cut.y, __try) >= 0) or (__try < __most and levenshtein(__cut.x, __cut.y, __most) >= 0)")
    bounds = F.when(lacking(F.col("a_runs"), F.col("b_runs"), F.col("__most")) > RUN * F.col("__most"), False).when(edits_by_words(F.col("a_line"), F.col("b_line")) <= F.col("__most"), True)
    pairs = tried(met(near).withColumn("__words", F.when(F.col("__long") <= LONG, words)))
    told = Saved(pairs.select("a", "b", F.when(F.col("__long") > LONG, bounds).otherwise(by_edits).alias("linked")), "line-told")
    open_ = tried(met(told.df.where("linked is null").select("a", "b")).withColumn("__words", words))
    out = Saved(told.df.where("linked").select("a", "b").unionByName(open_.where(by_edits).select("a", "b")), "line-links").df
    told.drop()
    return out


def linked(a: str, b: str) -> Column:
    """Whether the edit similarity of the lines a_line and b_line, neither of them long, is LIKENESS or more, as one
    expression: edits of words first, which say how wide a band of characters is worth a try."""
    x, y = F.col(f"{a}_line"), F.col(f"{b}_line")
    most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - LIKENESS) + 1e-9).cast("int")
    edits = lambda p, q, k: F.call_function("levenshtein", p, q, k)
    words = edits(F.col(f"{a}_coded"), F.col(f"{b}_coded"), (F.length(f"{a}_coded") / 10).cast("int") + 1)
    band = F.transform(F.array(words), lambda n: F.when(n >= 0, F.least(most, 5 * n + 2)).otherwise(0))[0]

    def told(v: Column) -> Column:
        cut, near = v["cut"], v["band"]
        return (F.greatest(F.length(cut["x"]), F.length(cut["y"])) <= most) | (near > 0) & (edits(cut["x"], cut["y"], near) >= 0) | (near < most) & (edits(cut["x"], cut["y"], most) >= 0)

    return F.transform(F.array(F.struct(trimmed(x, y).alias("cut"), band.alias("band"))), told)[0]


def shared_bucket() -> Column:
    """Of the buckets that x and y share, the one in which the pair is looked at, chosen by the pair, so that the pairs
    of a group that shares several are spread over them."""
    pair = F.xxhash64(F.least("x_id", "y_id"), F.greatest("x_id", "y_id"))
    both = F.array_sort(F.array_intersect("x_buckets", "y_buckets"))
    return F.transform(F.array(both), lambda b: F.get(b, F.pmod(pair, F.size(b)).cast("int")))[0]


def central(shared: DataFrame) -> DataFrame:
    """bucket and head of buckets (bucket, id, sim, size, n): the member nearest to what most members' SimHashes say, bit
    by bit, of two the one with the smaller id. Copies of one line with edits of their own are far from each other and
    near to that line, so that it is the one to meet first. Of a large bucket a share of some 64 members votes; which
    member is met first changes no result."""
    votes = F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / 64)) == 0
    lane = lambda k: F.sum(F.when(votes, F.shiftrightunsigned("sim", k).bitwiseAND(F.lit(_LANES))).otherwise(F.lit(0).cast("long")))
    summed = shared.where("n > 2").groupBy("bucket").agg(*(lane(k).alias(f"v{k}") for k in range(8)), F.count_if(votes).alias("voters"))
    centres = summed.select(F.col("bucket").alias("__bucket"), bits([F.col(f"v{k}") for k in range(8)], F.col("voters")).alias("centre"))
    met = shared.join(centres, F.col("bucket") == F.col("__bucket"), "left")
    away = F.coalesce(F.bit_count(F.col("sim").bitwiseXOR(F.col("centre"))), F.lit(0))
    return met.groupBy("bucket").agg(F.min(F.struct(away.alias("away"), "id", "sim", "size")).alias("head"))


def line_components(lines: DataFrame) -> DataFrame:
    """id and component of the lines (id, line) that have a link.

    As in components.bucket_components, every member first meets one of its bucket, here a central one, and then, where
    a bucket still holds several components, those outside its largest one meet the others, block by block. SimHashes,
    sizes and lines go with the members of these, and a pair that shares several buckets is compared in one of them: what
    leaves the join, and is written, is links, whose ends were in two components, and pairs with a line above LONG. How
    many pairs it compares still grows with a bucket's members times those outside its largest component. The texts of
    lines that share a bucket are looked up once.
    """
    hashed = Saved(signatures(lines), "line-buckets")
    met = Saved(shared_buckets(hashed.df), "line-shared")
    hashed.drop()
    shared = Saved(met.df.join(central(met.df), "bucket"), "line-shared")
    met.drop()
    wanted = shared.df.select(F.col("id").alias("__id")).distinct()
    texts = Saved(comparable(lines.join(wanted, F.col("id") == F.col("__id"), "left_semi")), "line-texts")
    ends = [F.least("head.id", "id").alias("a"), F.greatest("head.id", "id").alias("b")]
    sides = shared.df.where("id <> head.id").select(*ends, F.col("size").alias("x_size"), F.col("head.size").alias("y_size"), F.col("sim").alias("x_sim"), F.col("head.sim").alias("y_sim"))
    pairs = Saved(sides.where(alike()).select("a", "b").distinct(), "line-near")
    first = edit_links(pairs.df, texts.df)
    pairs.drop()
    components = connected_components(first)
    placed = with_component(shared.df.where("n > 2").select("bucket", "id", "sim", "size", F.col("head.id").alias("head")), "id", components)
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1").drop("k")
    placed = Saved(placed.join(mixed, "bucket").where("id <> head"), "line-placed")
    # the head has met them all; the others of a bucket are cut into blocks, and those outside its largest component are sent to each
    shares = placed.df.groupBy(F.col("id").alias("__id")).agg(F.collect_set("bucket").alias("buckets"))
    known = placed.df.join(shares, F.col("id") == F.col("__id")).drop("__id")
    own = texts.df.select(F.col("id").alias("__id"), *(F.when(F.length("line") <= LONG, F.col(c)).alias(c) for c in ("line", "coded")))
    known = known.join(own, F.col("id") == F.col("__id"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "component", "sim", "size", "buckets", "line", "coded")]
    few = known.where("component <> most").select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *side("x"))
    others = known.select("bucket", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "most", *side("y"))
    # few bytes, but much to compare: by number, so that the parts aren't merged by their size
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few, others = (df.repartition(parts, "bucket", "block") for df in (few, others))
    long = F.expr("x_line is null or y_line is null")
    met = few.join(others, ["bucket", "block"]).where(F.expr("x_component <> y_component and (y_component = most or x_id < y_id)") & alike() & (F.col("bucket") == shared_bucket()) & (long | linked("x", "y")))
    others = Saved(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), long.alias("long")), "line-near")
    shared.drop(), placed.drop()
    out = connected_components(first.unionByName(others.df.where("not long").select("a", "b")).unionByName(edit_links(others.df.where("long").select("a", "b"), texts.df)))
    texts.drop()
    return out


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version and removed: the line numbers (from 0) that go from each text that loses any.

    Edge cases: a null text has no lines; lines without letters or digits are never removed; a row with a null key
    keeps all its lines and removes none elsewhere; repeated rows (key and text) are one and keep the same lines; the
    first occurrence is that of the smallest key, then text, then line; long lines are compared by edits like others; extra
    columns are ignored; an empty table gives an empty result.
    """
    at = F.struct("doc", "version", "n")
    with Scope() as scope:
        every = lines_of(docs, key, text).where("line <> ''")
        lines = Saved(every.groupBy("id").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.min("line").alias("line")), "line-firsts").df
        places = Saved(every.select("doc", "version", "n", "id"), "line-places").df
        components = line_components(lines.select("id", "line"))
        # a line without a link that stands once stays; the others keep their group's first occurrence
        firsts = lines.select("id", "first", "copies")
        several = with_component(firsts, "id", components.select("id", "component"))
        groups = several.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("members")).where("members > 1")
        kept = Saved(several.join(groups, "component").select(F.col("id").alias("__id"), "keep", "copies"), "line-kept").df
        total = firsts.agg(F.sum("copies")).first()[0] or 0
        hot = F.col("copies") > max(1, int(total * HOT_SHARE))
        same = F.col("id") == F.col("__id")
        hot_ids = F.broadcast(kept.where(hot))  # at most 1 / HOT_SHARE rows
        gone = places.join(hot_ids, same).where(at != F.col("keep"))
        cold = places.join(F.broadcast(kept.where(hot).select("__id")), same, "left_anti").join(kept.where(~hot), same).where(at != F.col("keep"))
        gone = gone.unionByName(cold)
        return scope.result(gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("n")).alias("removed")), "line-removed")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its columns, each text without the lines that stand elsewhere. Documents that had lines and keep
    none go; all others stay.

    Edge cases: as in repeated_lines; a null text stays null, and a row with a null key stays as it is; repeated rows
    stay, each without the same lines; extra columns pass through, whatever their names; an empty table stays empty.
    """
    # the table's columns go in one struct, so that no name of theirs meets one of ours
    own = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("own"), column(key).alias("key"), column(text).alias("text"), F.xxhash64(column(text)).alias("hash"))
    met = own.join(repeated_lines(docs, key, text), (F.col("key") == F.col("doc")) & (F.col("hash") == F.col("version")), "left")
    left = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    # the outer transform binds the split text, so that it is split once and not for each line
    short = F.transform(F.array(F.split(F.col("text"), "\n")), lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n"))[0]
    met = met.withColumn("short", F.when(F.col("removed").isNull(), F.col("text")).otherwise(short))
    met = met.where(F.col("removed").isNull() | F.col("short").rlike(r"[\p{L}\p{N}]"))
    return met.select(*(F.col("short").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, how many go, and their numbers."""
    docs = table(spark, sf_dir, "documents")
    gone = repeated_lines(docs)
    sizes = docs.select("doc_id", F.xxhash64("text").alias("v"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    met = sizes.join(gone, (F.col("doc_id") == F.col("doc")) & (F.col("v") == F.col("version")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return met.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))
