"""Spelling variants: words of a corpus that differ by one code point, and the form each goes back to.

Of two words that differ by one inserted, deleted or replaced code point either the first half or the last half is the
same in both. So words are put into blocks of equal beginnings (the forward dictionary) and of equal endings (the
reversed one), once for each length that the shorter word of a pair may have. A block that is too large is
subdivided: what lies between the known beginning and ending is halved again, and each word goes on under both
halves. At the end only one code point is open, so a block can't hold more words than there are code points for it.
Blocks are neighbours in the sorted dictionary; each range of it is scanned once, and pairs are verified in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, text_of

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 256
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Rows of a matrix of code points that are compared with all others at once.
STRIP = 64


def runs(docs: DataFrame, shortest: int) -> DataFrame:
    """id (text, empty for null), run: the maximal runs of letters of at least ``shortest`` code points, A-Z lower-cased."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    found = F.regexp_extract_all(text_of(), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    return docs.select(ident, F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))


def vocabulary(words: DataFrame, shortest: int, at_least: int = 2) -> DataFrame:
    """word, n, of ``words`` (word): those that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _blocked(vocabulary: DataFrame) -> DataFrame:
    """word, n, short, head, tail: a word under the halves it may share, for pairs whose shorter word has ``short`` code points."""
    length = F.length("word")
    short = F.explode(F.array(length - 1, length)).alias("short")
    halves = F.array(F.struct(F.floor(F.col("short") / 2).cast("int").alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("short") - F.floor(F.col("short") / 2)).cast("int").alias("tail")))
    return vocabulary.select("word", "n", short).select("word", "n", "short", F.inline(halves))


def _key():
    """A block's name: what its words share, and where."""
    beginning, ending = F.substring("word", F.lit(1), F.col("head")), F.right("word", F.col("tail"))
    return F.concat_ws("\u0001", beginning, ending, "short", "head", "tail").alias("block")


def _subdivided(rows: DataFrame) -> DataFrame:
    """The same words under half of what was open, from either side."""
    open_, half = F.col("short") - F.col("head") - F.col("tail"), F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    parts = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("tail") + open_ - half).alias("tail")))
    return rows.select("word", "n", "short", parts.alias("parts")).select("word", "n", "short", F.inline("parts"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """block, word, n, short, head, tail: any two near words are in one block, and none has many more than ``most`` words.

    Only blocks with one code point open, or none, may be larger: the letters that can stand there bound them.
    """
    todo, done, step = _blocked(words), [], 0
    while True:
        rows = materialize(todo.select(_key(), "word", "n", "short", "head", "tail"), f"dictionary-{step}")
        # a pair needs a word of the shorter length
        sizes = rows.groupBy("block").agg(F.count("*").alias("size"), F.min(F.length("word") - F.col("short")).alias("least")).where("size > 1 and least = 0")
        sizes = materialize(sizes.select("block", "size"), f"blocks-{step}")
        large = (F.col("size") > most) & (F.col("short") - F.col("head") - F.col("tail") > 1)
        sized = rows.join(sizes, "block")
        done.append(sized.where(~large).drop("size"))
        if not sizes.where(F.col("size") > most).limit(1).count():
            break
        todo, step = _subdivided(sized.where(large)), step + 1
        if not todo.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _points(words: list[str], head: int, tail: int) -> np.ndarray:
    """Code points of what is open, a row for each word; the words are of one length."""
    width = len(words[0]) - head - tail
    return np.array([[ord(c) for c in w[head : len(w) - tail]] for w in words], np.int32).reshape(len(words), width)


def near_pairs(words: list[str], short: int, head: int, tail: int) -> list[tuple[int, int]]:
    """Pairs of indices of words one edit apart; the shorter one of a pair has ``short`` code points."""
    equal = [i for i, w in enumerate(words) if len(w) == short]
    longer = [i for i, w in enumerate(words) if len(w) == short + 1]
    if not equal:
        return []
    found = []
    a = _points([words[i] for i in equal], head, tail)
    width = a.shape[1]
    if width and len(equal) > 1:
        for at in range(0, len(equal), STRIP):
            differ = (a[at : at + STRIP, None, :] != a[None, :, :]).sum(2)
            found += [(equal[at + i], equal[j]) for i, j in np.argwhere(differ == 1).tolist() if at + i < j]
    if longer:
        b = _points([words[i] for i in longer], head, tail)
        for at in range(0, len(equal), STRIP):
            rows = a[at : at + STRIP, None, :]
            same = np.cumprod(rows == b[None, :, :-1], 2).sum(2)
            same += np.cumprod((rows == b[None, :, 1:])[:, :, ::-1], 2).sum(2)
            found += [(equal[at + i], longer[j]) for i, j in np.argwhere(same >= width).tolist()]
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each block, from rows that are sorted by block."""
    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "word", "n", "short", "head", "tail")), strict=True):
            if held and held[0][0] != row[0]:
                out += _verified(held)
                held = []
            held.append(row)
        yield _pairs(out)
    if held:
        yield _pairs(_verified(held))


def _verified(block: list[tuple]) -> list[tuple]:
    words = [r[1] for r in block]
    return [(block[i][1], block[i][2], block[j][1], block[j][2]) for i, j in near_pairs(words, *block[0][3:])]


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    a, n_a, b, n_b = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n_a, pa.int64()), pa.array(b, pa.string()), pa.array(n_b, pa.int64())], names=["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, near, near_n: each pair of near words from both sides, once."""
    dealt = blocks(words, most).repartitionByRange("block").sortWithinPartitions("block", "word")
    pairs = dealt.mapInArrow(_scanned, "a string, n_a bigint, b string, n_b bigint")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    # the edit may leave both halves intact, so a pair may come from several blocks
    return both.groupBy(F.col("a").alias("word"), F.col("b").alias("near")).agg(F.first("n_b").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word of ``forms`` (word, form) along the forms to the last.

    Pointers double in length each round. A form is ``RATIO`` times as frequent as its word, so chains have fewer than
    20 steps (counts are below 10^19), and five rounds reach their ends.
    """
    now = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    for step in range(5):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(now.join(further, "root", "left"), f"roots-{step}")
        now = ahead.select("word", F.coalesce("further", "root").alias("root"))
        if not ahead.where("further is not null").limit(1).count():
            break
    return now


def spelling_variants(words: DataFrame, shortest: int = 7, at_least: int = 2, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for the distinct words of ``words`` (word).

    A word has at least ``shortest`` code points and ``at_least`` occurrences. Its form is the most frequent of its near words, of
    several the first by code point, if it is at least ``ratio`` (10 or more) times as frequent; else null. The
    root is the end of the chain of forms, the word itself if it has none. Null words are left out; an empty table gives
    an empty result; words may be of any length.
    """
    if ratio < 10:
        raise ValueError("the bound on chains of forms needs a ratio of 10 or more")
    known = materialize(vocabulary(words, shortest, at_least), "vocabulary")
    near = near_words(known, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    told = materialize(told.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "near-words")
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
