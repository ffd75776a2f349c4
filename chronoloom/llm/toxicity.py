"""Toxicity: a lexicon learned from labels, found in texts by Levenshtein automata walked along the lexicon's trie.

Fitting counts, over all labelled training rows, in how many toxic and clean documents a word or a word's stem (its
first letters) stands; the terms whose share of toxic documents is beyond chance make the lexicon, each with the log
of its likelihood ratio. Scoring walks each word of a text down the trie together with an automaton that accepts one
edit, so misspelt terms are caught; the words around a hit say whether it is quoted or meant, and weigh it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, filtered, rows_of, table
from chronoloom.llm.neardup import WordHashes, scrambled

FOLDS, HELD_OUT = 5, 0
STEMS = (4, 5, 6, 7)
#: Chance terms that the whole lexicon is expected to hold, at most.
CHANCE = 0.2
#: Terms whose toxic share is lower are left out.
LEAST_TOXIC = 0.6
#: Words of at least so many letters are also matched with one edit, and such a hit weighs this much less.
FUZZY_LETTERS, FUZZY = 5, 0.8
WINDOW, QUOTED = 6, 0.4
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset("said says called quoted quote cited reported wrote citation zitat zitiert sagte dijo cita dit citait".split())
WORD = re.compile(r"[^\W\d_]+")
#: Words with single digits, underscores or symbols between.
CHAIN = re.compile(r"[^\W\d_]++(?:(?:[\d_]|[^\w\s])[^\W\d_]++)++")


def terms_of(text: str) -> set[str]:
    """The distinct words of a text, and their stems with a star."""
    words, _ = words_of(text.lower())
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def words_of(low: str) -> tuple[set[str], bool]:
    """The distinct words of a text, and whether any two of them may be glued: what stands between blanks and is all
    letters is a word, the rest is searched."""
    pieces = set(low.split())
    odd = [p for p in pieces if not p.isalpha()]
    return pieces.difference(odd).union(*map(WORD.findall, odd)), any(map(CHAIN.search, odd))


def glued(low: str) -> Iterator[tuple[int, str, str, str]]:
    """Where two words stand with one digit or symbol between them, what they and it make together, and the two. More
    than one such character is more than one edit."""
    for chain in CHAIN.finditer(low):
        for a, b in pairwise(WORD.finditer(chain[0])):
            yield chain.start() + a.start(), chain[0][a.start() : b.end()], a[0], b[0]


def without_a_letter(word: str) -> list[str]:
    """The word, and the word without each of its letters."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Lexicon:
    """A trie of weighted terms. A node maps letters to nodes; '' holds a word that ends there and its weight, '*' the
    weight of a stem that ends there. near: the weight of a word one edit away from a term."""

    def __init__(self, weights: Iterable[tuple[str, float]], prior: float, near: dict[str, float] | None = None) -> None:
        self.prior, self.root, self.parts, self.near = prior, {}, set(), near
        for term, weight in weights:
            stem, node = term.endswith("*"), self.root
            word = term[:-1] if stem else term
            for c in word:
                node = node.setdefault(c, {})
            node["*" if stem else ""] = weight if stem else (word, weight)
            if not stem and len(word) >= FUZZY_LETTERS:
                # two words one edit apart are equal once a letter is left out of either or both
                self.parts.update(without_a_letter(word))

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("*", 0.0))
        return max(best, node.get("", ("", 0.0))[1])

    def maybe_misspelt(self, word: str) -> bool:
        return len(word) >= FUZZY_LETTERS - 1 and not self.parts.isdisjoint(without_a_letter(word))

    def within_one(self, word: str) -> list[tuple[str, float]]:
        """The whole words one edit away, with their weights: the automaton's states (positions in `word` with the
        edits made so far) move along the trie, and a branch without a state is not entered."""
        if not self.maybe_misspelt(word):
            return []
        found, length = [], len(word)
        stack = [(self.root, 0, {0: 0, 1: 1})]  # node, letters walked, position -> fewest edits
        while stack:
            node, walked, states = stack.pop()
            if "" in node and walked >= FUZZY_LETTERS and states.get(length, 2) <= 1:
                found.append(node[""])
            for c, below in node.items():
                if c in ("", "*"):
                    continue
                moved: dict[int, int] = {}
                for at, edits in states.items():
                    if at < length and word[at] == c:
                        moved[at + 1] = min(edits, moved.get(at + 1, 2))
                    if edits < 1:
                        moved[at] = min(edits + 1, moved.get(at, 2))  # c is extra in the term
                        if at < length:
                            moved[at + 1] = min(edits + 1, moved.get(at + 1, 2))  # c stands for another letter
                for at in [p for p, e in moved.items() if e == 0 and p < length]:
                    moved.setdefault(at + 1, 1)  # the term lacks a letter of the word
                if moved:
                    stack.append((below, walked + 1, moved))
        return found

    def weight(self, word: str) -> float:
        """Of a word as it stands, or else of what it may misspell: what labels say of such words, or by default FUZZY of the term's."""
        if known := self.exact(word):
            return known
        return max((w * FUZZY if self.near is None else self.near.get(t, w * FUZZY) for t, w in self.within_one(word)), default=0.0)


def quoted(text: str, words: list[re.Match], k: int) -> bool:
    """Whether word k stands in quotation marks, or a word of reporting stands shortly before it."""
    first, last = max(0, k - WINDOW), min(len(words) - 1, k + WINDOW)
    before, after = text[words[first].start() : words[k].start()], text[words[k].end() : words[last].end() + 1]
    marks = lambda s: sum(s.count(q) for q in QUOTES)
    return marks(before) % 2 == 1 and marks(after) > 0 or any(w[0].lower() in REPORTING for w in words[first:k])


class Scorer:
    """Keeps what it has found for words, up to a number of words."""

    def __init__(self, lexicon: Lexicon, keep: int = 500_000) -> None:
        self.lexicon, self.known, self.keep = lexicon, {}, keep

    def weight(self, word: str) -> float:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            found = self.known[word] = self.lexicon.weight(word)
        return found

    def score(self, text: str) -> float:
        low, prior, weight = text.lower(), self.lexicon.prior, self.weight
        words, chained = words_of(low)
        hits = {w: x for w in words if (x := weight(w)) > 0}
        spelt: dict[str, list[int]] = {}
        for at, token, a, b in glued(low) if chained else ():
            if a not in hits and b not in hits and (x := weight(token)) > 0:
                spelt.setdefault(token, []).append(at)
        hits |= {token: weight(token) for token in spelt}
        if hits:
            words, best = list(WORD.finditer(low)), dict.fromkeys(hits, 0.0)
            for k, m in enumerate(words):
                if m[0] in hits and best[m[0]] < hits[m[0]]:
                    best[m[0]] = max(best[m[0]], hits[m[0]] * (QUOTED if quoted(low, words, k) else 1.0))
            if spelt:
                places = {m.start(): k for k, m in enumerate(words)}
                for token, starts in spelt.items():
                    best[token] = max(hits[token] * (QUOTED if quoted(low, words, places[at]) else 1.0) for at in starts)
            for i, x in enumerate(sorted(best.values(), reverse=True)):
                prior += math.ldexp(x, -i)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, prior))))


def fold_of(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def term_counts(train: DataFrame, terms_of: Callable[[str], set[str]]) -> DataFrame:
    """term, toxic and clean: in how many rows of train (__y, __text) a term stands; '' stands for the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            terms = sorted(found[0].keys() | found[1].keys())
            columns = [pa.array(terms, pa.string()), *(pa.array([found[y][t] for t in terms], pa.int64()) for y in (1, 0))]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

        for batch in batches:
            for part in rows_of(batch):
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[y].update(terms_of(t))
                    found[y][""] += 1
                if len(found[0]) + len(found[1]) > 500_000:
                    yield out()
        yield out()

    counts = train.mapInArrow(run, "term string, toxic long, clean long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def distinct_examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """__y and __text of the labelled rows that are not held out, one for each distinct text, so that copies count
    once; it is toxic if any of its rows is. Only hashes are grouped: texts move once, to the keys that stand for them."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("__y"))
    train = docs.select(F.col(key), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__h")).where(F.col(text).isNotNull() & (fold_of(key) != HELD_OUT))
    # by merge at every size: a plan that broadcasts small labels would say nothing of large ones
    chosen = train.select(key, "__h").join(marked.hint("merge"), key).groupBy("__h").agg(F.min(key).alias(key), F.max("__y").cast("int").alias("__y"))
    return train.join(chosen.hint("merge"), [key, "__h"]).dropDuplicates([key, "__h"]).select("__y", "__text")


def beyond_chance(counts: DataFrame, n_toxic: int, n_clean: int, vocabulary: int) -> DataFrame:
    """The rows of counts (term, toxic, clean) that learn() accepts. Chance alone gets CHANCE terms into it; each needs
    log(vocabulary / base / CHANCE) / log(1 / base) toxic texts at least, so there are at most as many terms as toxic
    texts hold in all, over this number."""
    base = n_toxic / (n_toxic + n_clean)
    share, n = F.col("toxic") / (F.col("toxic") + F.col("clean")), F.col("toxic") + F.col("clean")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    bound = F.log(F.lit(vocabulary / base)) - n * (share * F.log(share / base) + rest)
    return counts.where((F.col("term") != "") & (F.col("toxic") > 0) & (share >= max(LEAST_TOXIC, base)) & (bound <= math.log(CHANCE) + 1e-9))


def words_under(terms: DataFrame, weights: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The words of toxic texts that stems of the lexicon stand for, with the stems' weights: so they are matched with an
    edit, too."""
    stems = {t[:-1]: x for t, x in weights if t.endswith("*")}
    if not stems:
        return []
    begins = [F.substring("term", 1, n).isin([s for s in stems if len(s) == n]) for n in sorted({len(s) for s in stems})]
    words = terms.where((F.col("toxic") > 0) & ~F.col("term").endswith("*") & (F.length("term") >= FUZZY_LETTERS) & reduce(lambda a, b: a | b, begins)).select("term")
    return [(r.term, max(stems.get(r.term[:n], 0.0) for n in STEMS)) for r in words.collect()]


def fit_lexicon(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Counts over all distinct labelled texts that are not held out.

    Edge cases: a row with a null key, label or text, or a label that is neither 0 nor 1, is no example; copies of a
    text are one, toxic if any of them is; a key with several labels has the largest; extra columns are ignored;
    without toxic or without clean examples (also for empty tables) the lexicon is empty and all scores are low.
    """
    with Scope():
        train = Saved(distinct_examples(docs, labels, key, text, label), "toxicity-train").df
        return _fitted(train, Saved(term_counts(train, terms_of), "toxicity-terms").df)


def _fitted(train: DataFrame, terms: DataFrame) -> Lexicon:
    spark = train.sparkSession
    vocabulary, n_toxic, n_clean = terms.agg(F.count_if(F.col("toxic") > 0), *(F.max(F.when(F.col("term") == "", F.col(c))) for c in ("toxic", "clean"))).first()
    if not n_toxic or not n_clean:
        return Lexicon([], -3.0)
    counts = {r.term: (r.toxic, r.clean) for r in beyond_chance(terms, n_toxic, n_clean, vocabulary).collect()}
    weights = learn(without_parts(independent(train, counts)), n_toxic, n_clean, vocabulary)
    weights += words_under(terms, weights)
    prior = math.log(n_toxic / n_clean) - 1.0
    plain = spark.sparkContext.broadcast(Lexicon(weights, prior))
    near = {r.term: ratio(r.toxic, r.clean, n_toxic, n_clean) for r in term_counts(train, lambda t: Known.of(plain, misspelt).terms(t)).collect() if r.term}
    return Lexicon(weights, prior, near)


def sketch(text: str, hashes: WordHashes) -> int:
    """The smallest hash of three words in a row: mostly the same for near copies, and hardly ever else."""
    h = np.array([hashes[w.encode("utf-8", "surrogatepass")] for w in WORD.findall(text.lower())], np.uint64)
    rows = scrambled(scrambled(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:]) if len(h) > 2 else h
    return int(rows.min().astype(np.int64)) if len(rows) else 0


def independent(train: DataFrame, counts: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """The counts of the terms as if near copies were one text: of texts that fall into groups of c by their sketch,
    (sum of c)^2 / sum of c^2 count, that is all of them where all are different and one where all are alike."""
    if not counts:
        return {}
    held = train.sparkSession.sparkContext.broadcast(frozenset(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in rows_of(batch):
                rows = []
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if found := held.value & terms_of(t):
                        value = sketch(t, hashes)
                        rows += [(term, y, value) for term in found]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "y", "sketch"])

    groups = train.mapInArrow(run, "term string, y int, sketch long").groupBy("term", "y", "sketch").agg(F.count("*").alias("c"))
    sums = groups.groupBy("term", "y").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    whole = {(r.term, r.y): round(r.n * r.n / r.s) for r in sums.collect()}
    return {t: (whole.get((t, 1), 0), whole.get((t, 0), 0)) for t in counts}


def misspelt(word: str, lexicon: Lexicon) -> tuple[str, ...]:
    """The terms that a word is one edit away from, if it is none itself."""
    return () if not lexicon.maybe_misspelt(word) or lexicon.exact(word) else tuple(t for t, _ in lexicon.within_one(word))


class Known:
    """What `find` says of words, kept for up to KEEP words; one for each broadcast in a worker."""

    KEEP = 500_000
    _last: tuple = (None, None)

    def __init__(self, find: Callable, value: object) -> None:
        self.find, self.value, self.known = find, value, {}

    @classmethod
    def of(cls, broadcast, find: Callable) -> Known:
        if cls._last[0] is not broadcast:
            cls._last = (broadcast, cls(find, broadcast.value))
        return cls._last[1]

    def terms(self, text: str) -> set[str]:
        known, out, low = self.known, set(), text.lower()
        words, chained = words_of(low)
        for w in {*words, *(token for _, token, _, _ in glued(low))} if chained else words:
            if (terms := known.get(w)) is None:
                if len(known) >= self.KEEP:
                    known.clear()
                terms = known[w] = self.find(w, self.value)
            if terms:
                out.update(terms)
        return out


def without_parts(counts: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Without stems that one longer term explains (it has most of their toxic rows), and without terms that begin
    with a stem that stays."""
    longer: dict[str, int] = Counter()
    for term, (t, _) in counts.items():
        word = term.rstrip("*")
        for n in STEMS:
            if n < len(word) or n == len(word) and not term.endswith("*"):
                longer[word[:n] + "*"] = max(longer[word[:n] + "*"], t)
    stems = {s for s, (t, _) in counts.items() if s.endswith("*") and longer[s] < 0.8 * t}
    return {t: x for t, x in counts.items() if t in stems or not t.endswith("*") and not any(f"{t[:n]}*" in stems for n in STEMS)}


def ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def learn(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, vocabulary: int) -> list[tuple[str, float]]:
    """The terms whose toxic share chance doesn't explain, with their log likelihood ratios. vocabulary: the terms of
    toxic rows, and a share of all terms about as large as the share of such rows or larger."""
    base = n_toxic / (n_toxic + n_clean)
    out = []
    for term, (t, c) in counts.items():
        share = t / (t + c) if t else 0
        if share < max(LEAST_TOXIC, base):
            continue
        # Chernoff's bound of the chance that so many of t + c rows are toxic, if each is with probability base
        bound = -(t + c) * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0))
        if vocabulary / base * math.exp(bound) <= CHANCE:
            out.append((term, ratio(t, c, n_toxic, n_clean)))
    return out


def score_toxicity(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row's whole text, in the order of docs and without a shuffle.

    Edge cases: a null or empty text has no hits and scores the prior; a null key passes through; repeated rows score
    alike; other columns, whatever their names, are never read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value).score
        for batch in batches:
            for part in rows_of(batch):
                scores = pa.array([score(t or "") for t in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], names=[key, "score"])

    source = docs.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, with all their columns; nothing is shuffled.

    Edge cases: as in score_toxicity; null and empty texts score the prior and stay; repeated rows fare alike; columns
    of any name pass through; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def keep() -> Callable[[list], list[bool]]:
        score = Scorer(held.value).score
        return lambda texts: [score(t or "") < limit for t in texts]

    return filtered(docs, text, keep)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_lexicon(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
