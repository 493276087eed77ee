"""Spelling variants: words one edit apart, found by pivotal bigrams, and the more frequent form of each.

Bigrams are ranked by the number of words that hold them, rarest first.  A word's prefix is its first three bigrams in that
order (all places of the last one included).  One edit destroys two overlapping bigrams at most, so of two disjoint bigrams of
the prefix, the pivots, one stands in any word one edit away; and it stands in that word's prefix if the prefix ends at the
same rank or later.  So pivots of each word meet prefixes of the others.  The place of a pivot limits the edit to one side of
it: the letters up to it, or those from it on, are the same in both words.  These letters and the other word's length are
the key of the join, and a pair that meets is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.common import q
from ..session import materialize

GAP = re.compile("[^A-Za-zÀ-ÿ]")
PIECE = 1 << 20  # characters of a text that are cut into runs at a time
NOISE = 199
EDITS, GRAM = 1, 2


def runs_of(text: str, min_length: int = 1) -> Counter:
    """Numbers of the runs of letters of a text that have ``min_length`` code points, A-Z in lower case."""
    out, at, pattern = Counter(), 0, re.compile("[a-zÀ-ÿ]{%d,}" % min_length)
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        out.update(pattern.findall(text[at:end].encode().lower().decode()))  # lower() of bytes is that of A-Z alone
        at = end
    return out


def written(run: str, h: int) -> str:
    """The run as it counts where ``h`` is the CRC-32 of id and run: one letter less if NOISE divides it."""
    if h % NOISE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words with that many code points and occurrences, over all documents.

    Null and empty texts have no words; a null doc_id changes no run; repeated rows count again; a very long text is cut into
    runs piece by piece.  A batch of documents sends each of its words once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = Counter()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = runs_of(text.as_py() or "", min_length)
                if doc_id is None:
                    total.update(found)
                    continue
                start = zlib.crc32(b"%d:" % doc_id)
                for w, n in found.items():
                    total[written(w, zlib.crc32(w.encode(), start))] += n
            words = [w for w in total if len(w) >= min_length]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    parts = docs.select(q("doc_id").cast("long").alias("doc_id"), q("text").alias("text")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram by the number of words that hold it, rarest first, ties by the bigram.

    The alphabet has 26 + 64 letters, so there are 8100 bigrams at most, whatever the number of words.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.col("word").substr(k, F.lit(GRAM))))
    found = words.where(F.char_length("word") >= GRAM).select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return {r["g"]: k for k, r in enumerate(found.orderBy("n", "g").collect())}


def prefix_of(word: str, rank: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """(place, rank) of the bigrams of the prefix, by place, and the rank of the last one."""
    grams = sorted((rank[word[k:k + GRAM]], k) for k in range(len(word) - GRAM + 1))
    last = grams[min(len(grams), GRAM * EDITS + 1) - 1][0]
    return sorted((k, r) for r, k in grams if r <= last), last


def pivots_of(prefix: list[tuple[int, int]], rarity: dict[int, float] | None = None) -> list[int]:
    """Places of EDITS + 1 disjoint bigrams of the prefix with the least sum of ranks, by dynamic programming over places.

    ``best[j]`` is the least (sum, places) of j bigrams that end before the place at hand; None if there are fewer.
    """
    want = EDITS + 1
    states = [(-GRAM, [(0, ())] + [None] * want)]  # after each place: the best choice of 0, 1, ... bigrams
    for place, r in prefix:
        free = next(best for at, best in reversed(states) if at + GRAM <= place)
        best = list(states[-1][1])
        for j in range(want):
            if free[j] is not None:
                new = (free[j][0] + r, (*free[j][1], place))
                if best[j + 1] is None or new < best[j + 1]:
                    best[j + 1] = new
        states.append((place, best))
    return list((states[-1][1][want] or (0, ()))[1])


def _keys(words: DataFrame, rank: dict[str, int], pivots: bool) -> DataFrame:
    """(side, letters, length, last, word) of the pivots, for words of length - 1 to length + 1, or of the prefixes.

    Side 0 holds the letters up to the end of the bigram, side 1 those from its start.  ``last`` is the rank at which the
    word's prefix ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"side": [], "letters": [], "length": [], "last": [], "word": []}
            for w in b.column(0).to_pylist():
                prefix, last = prefix_of(w, rank)
                for k in pivots_of(prefix) if pivots else [k for k, _ in prefix]:
                    for side, letters in ((0, w[:k + GRAM]), (1, w[k:])):
                        for n in range(len(w) - EDITS, len(w) + EDITS + 1) if pivots else [len(w)]:
                            for name, v in zip(out, (side, letters, n, last, w)):
                                out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["side"], pa.int32()), pa.array(out["letters"], pa.string()), pa.array(out["length"], pa.int32()),
                                              pa.array(out["last"], pa.int32()), pa.array(out["word"], pa.string())], list(out))

    return words.select("word").mapInArrow(run, "side int, letters string, length int, last int, word string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different words that differ by one inserted, deleted or replaced letter.

    ``words`` has distinct words of at least four letters, so that each has three bigrams, two of them disjoint.
    """
    rank = gram_ranks(words)
    pivots = _keys(words, rank, True).withColumnsRenamed({"word": "p", "last": "p_last"})
    prefixes = _keys(words, rank, False)
    # shuffled on purpose: keys of both sides are many times the words, and a hot key can then be split
    met = pivots.join(prefixes.hint("merge"), ["side", "letters", "length"]).where("p <> word AND p_last <= last")
    close = met.where(F.levenshtein("p", "word", EDITS) == EDITS)
    return close.select(F.least("p", "word").alias("a"), F.greatest("p", "word").alias("b")).distinct()


def forms(counts: DataFrame, factor: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): each word's most frequent near word, ties to the smallest, if it is ``factor`` times as frequent.

    Words without near words have n_near 0 and null for the rest.
    """
    pairs = materialize(near_pairs(counts), "spelling")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    seen = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = seen.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    good = -F.col("best.k") >= factor * F.col("n")
    return (counts.join(best, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"),
                    F.when(good, -F.col("best.k")).alias("form_n")))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of the chain of forms.

    A form is more frequent by a factor, so there is no circle, and jumping from form to form's form halves every chain: the
    number of rounds grows with the logarithm of a chain, which itself grows with the logarithm of the corpus.
    """
    links = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling")
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(ends, "root", "left_semi").isEmpty():
            return links
        links = materialize(links.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling")


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of the documents.

    The form is the most frequent word one edit away if it is ``factor`` times as frequent; the root ends the chain of forms and
    is the word itself if it has no form.  An empty table has no words; columns besides doc_id and text are not read.
    """
    counts = materialize(word_counts(docs, min_length, min_count), "spelling")
    found = materialize(forms(counts, factor), "spelling")
    return (found.join(roots(found), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
