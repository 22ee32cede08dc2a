"""Secrets in text: fixed patterns, and values in a credential context that are costly to guess.

The value after a credential word is cut into words, dates, repeats, keyboard walks and brute-force
spans so that the product of the guesses for the parts is least. A value whose cheapest cut still
takes many guesses is a secret; one that a guesser reaches soon ("password: password1") is not. Words
cost their rank: the frequent words of the corpus itself are counted first, so that ordinary prose
after a credential word is cheap.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import give_back, materialize, row_groups

# The base patterns, and how many characters a match needs at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")

#: Further credential words; what follows them is looked at, and kept only if it is costly to guess. They
#: begin where a word or a capital in a word begins. The value is only looked ahead at, as it may itself
#: be such a word ("auth token: ..."). Group 1 is the separator, if there is one, group 2 how the value begins.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))(?i:pass(?:word|wd|phrase|code)|pwd|secret(?:[_-]?key)?|token|(?:api|access|private)[_-]?key|credentials?|auth(?:orization)?|bearer|signature)"""
    r"""(?=["']?(?:(\x20*[:=]+>?\x20*)|\x20+(?:(?i:is)\x20+)?)(?:(?i:bearer)\x20+)?["']?([!-&(-~]{6}))""",
    re.ASCII,
)
VALUE = re.compile(r"[!-&(-~]+")
#: Without a separator words alone are prose; hyphens and the like join them.
PROSE = re.compile(r"[A-Za-z]+(?:[-'./_,;:&][A-Za-z]+)*")
ANY_ASSIGN = r"(?i)password|passwd|secret|token|api_?key"
ANY_CONTEXT = r"(?i)pass(word|wd|phrase|code)|pwd|secret|token|[_-]?key|credential|auth|bearer|signature"

#: A value is a secret if its cheapest cut takes at least 10 to this many guesses.
MIN_LOG10_GUESSES = 10.0

#: Ranked words of the corpus: at most so many, of so many letters, each in so many distinct texts. These are told by 64
#: classes of their hash, so copies of a text never add to them.
MAX_WORDS = 50_000
MIN_TEXTS = 5
WORD_LETTERS = (3, 20)
#: Distinct words that a task counts before it hands them on.
COUNTED_AT_ONCE = 200_000
#: Text whose words are counted at once.
SLICE_BYTES = 1_000_000

# Common words of passwords and identifiers in order of how soon they are guessed.
WORDS = (
    "password pass word secret token key api admin user login root test demo example sample changeme default "
    "welcome letmein dragon monkey master shadow sunshine princess football baseball superman batman qwerty "
    "iloveyou trustno hello access account service server client public private access auth bearer basic "
    "database data base local host prod production dev development stage staging config value name string "
    "null none true false empty missing required optional invalid here your enter insert replace placeholder "
    "the and for not you with that this from have are was but all can her one our out day get has him his how "
    "man new now old see two way who did its let put say she too use summer winter spring autumn monday friday "
    "january february march april june july august september october november december"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
#: Letters that digits and signs stand in for.
LEET = str.maketrans("0134578@$!", "oleastbasi")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
#: Where a key is, in half widths: each row is shifted against the one above.
PLACE = {key: (row, 2 * column + shift) for row, (keys, shift) in enumerate(zip(KEY_ROWS, (0, 3, 4, 5), strict=True)) for column, key in enumerate(keys)}
DATES = [re.compile(p) for p in (r"(?:19|20)\d\d", r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d")]
#: Of a walk, run or repeat of up to so many characters any stretch may be a part; of a longer one all its beginnings and ends.
STRETCH = 64


def _brute(ch: str) -> float:
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isalpha() else math.log10(33)


def direction(a: str, b: str) -> tuple[int, int] | None:
    """The step from one key to a neighbour in any of six directions, or to the next letter; else None."""
    if a.isalpha() and b.isalpha() and abs(ord(b) - ord(a)) == 1:
        return (9, ord(b) - ord(a))
    if a not in PLACE or b not in PLACE:
        return None
    step = PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]
    near = abs(step[1]) == 2 if step[0] == 0 else abs(step[0]) == 1 and abs(step[1]) <= 2
    return step if near else None


def _stretches(i: int, j: int, least: int, step: int = 1) -> Iterator[tuple[int, int]]:
    """Parts of what runs from i to j, of at least ``least`` characters, by whole ``step``: see ``STRETCH``."""
    if j - i <= STRETCH:
        for a in range(i, j - least + 1):
            yield from ((a, b) for b in range(a + least, j + 1, step))
        return
    for size in range(least, j - i + 1):
        yield j - size, j - size + size // step * step
        yield i + size - size // step * step, i + size


def _walks(keys: str) -> Iterator[tuple[int, int, float]]:
    """Walks over the keyboard, or along the alphabet, of three keys and more, with their cost: where they start, how long they are, turns."""
    i = 0
    while i < len(keys) - 1:
        j, turns, last = i + 1, [0, 0], None  # turns before each key
        while j < len(keys) and (step := direction(keys[j - 1], keys[j])) is not None:
            turns.append(turns[-1] + (last is not None and step != last))
            last = step
            j += 1
        for a, b in _stretches(i, j, 3):
            yield a, b, math.log10(len(PLACE) * (b - a)) + (turns[b - i] - turns[a - i + 2]) * math.log10(6)
        i = max(j - 1, i + 1)


def _parts(value: str, ranks: dict[str, int]) -> list[list[tuple[int, float]]]:
    """For each end: the starts of parts that end there, with log10 of the guesses for each."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + WORD_LETTERS[0], min(n, i + WORD_LETTERS[1]) + 1):
            rank = ranks.get(low[i:j])
            swapped = rank is None and (rank := ranks.get(plain[i:j])) is not None
            if rank is not None:
                cased = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i + 1 : j] == low[i + 1 : j] else j - i)
                ends[j].append((i, math.log10(rank) + cased + (math.log10(4) if swapped else 0.0)))
        for date in DATES:
            if (found := date.match(low, i)) is not None:
                ends[found.end()].append((i, math.log10(120 * (365 if found.end() - i > 4 else 1))))
    i = 0
    while i < n:  # runs of one character
        j = i + 1
        while j < n and low[j] == low[i]:
            j += 1
        for a, b in _stretches(i, j, 3):
            ends[b].append((a, _brute(low[i]) + math.log10(b - a)))
        i = j
    for i, j, cost in _walks(low.translate(SHIFTED)):
        ends[j].append((i, cost))
    known: list[tuple[int, int, int]] = []  # what repeats with a period repeats with its multiples too
    for size in range(2, min(16, n // 2) + 1):  # blocks that repeat at once
        i = 0
        while i + 2 * size <= n:
            j = i
            while j + size < n and low[j] == low[j + size]:
                j += 1
            if j - i >= size and not any(size % s == 0 and a <= i and j + size <= b for a, b, s in known):  # each character is the one a block before, up to j + size
                if j + size - i > STRETCH:
                    known.append((i, j + size, size))
                for a, b in _stretches(i, j + size, 2 * size, size):
                    ends[b].append((a, sum(map(_brute, low[a : a + size])) + math.log10((b - a) // size)))
            i = max(j, i) + 1
    return ends


def suffix_costs(value: str, ranks: dict[str, int] = RANK) -> list[float]:
    """For each place: log10 of the guesses for the cheapest cut of the value from there to its end; linear in its length.

    Parts next to each other multiply; characters outside any part are brute force, each of its kind.
    """
    ends = _parts(value, ranks)
    best = [math.inf] * len(value) + [0.0]
    for j in range(len(value), 0, -1):
        best[j - 1] = min(best[j - 1], best[j] + _brute(value[j - 1]))
        for i, cost in ends[j]:
            best[i] = min(best[i], best[j] + cost)
    return best


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest cut of the whole value."""
    return suffix_costs(value, ranks)[0]


def _without_values(text: str) -> str:
    """The text without what stands after a credential word and a separator."""
    out, at = [], 0
    for m in CONTEXT.finditer(text):
        if m[1] is not None and m.start(2) >= at:
            out.append(text[at : m.start(2)])
            at = VALUE.match(text, m.start(2)).end()
    return "".join([*out, text[at:]])


def _summed(words: pa.Array, counts: np.ndarray, texts: np.ndarray) -> pa.Table:
    """One row for each word: the sum of counts, and all bits of texts."""
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(index, kind="stable")
    starts = np.flatnonzero(np.diff(index[order], prepend=-1))
    n, bits = (np.add.reduceat(counts[order], starts), np.bitwise_or.reduceat(texts[order], starts)) if len(starts) else (counts[:0], texts[:0])
    return pa.table({"word": coded.dictionary, "n": pa.array(n, pa.int64()), "texts": pa.array(bits.view(np.int64), pa.int64())})


def _counted(texts: pa.Array, hashes: np.ndarray) -> pa.Table:
    """The words of letters of some texts: how often, and in which classes of texts."""
    some = pc.match_substring_regex(texts, ANY_CONTEXT).to_pylist()
    if any(some):
        texts = pa.array([_without_values(t) if s else t for t, s in zip(texts.to_pylist(), some, strict=True)], pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    words = pc.ascii_trim(pc.ascii_lower(lists.flatten()), characters="\"'`.,:;!?()[]{}<>*_-")
    size = pc.binary_length(words)
    fits = pc.and_(pc.and_(pc.greater_equal(size, WORD_LETTERS[0]), pc.less_equal(size, WORD_LETTERS[1])), pc.match_substring_regex(words, "^[a-z]+$"))
    keep = fits.to_numpy(zero_copy_only=False)
    bits = (np.uint64(1) << (hashes % np.uint64(64)))[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[keep]]
    return _summed(words.filter(fits).cast(pa.string()), np.ones(len(bits), np.int64), bits)


def _again(held: pa.Table) -> pa.Table:
    held = held.combine_chunks()
    words, n, texts = (held.column(c).combine_chunks() if held.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("n", pa.int64()), ("texts", pa.int64())))
    return _summed(words, n.to_numpy(zero_copy_only=False), texts.to_numpy(zero_copy_only=False).view(np.uint64))


def word_ranks(docs: DataFrame, most: int = MAX_WORDS) -> dict[str, int]:
    """Words of letters by how often they are in all texts, after the fixed ones; 1 is guessed first.

    A word counts if it is in several distinct texts, so copies of one make no word common; what stands after a
    credential word and a separator is not counted at all. Tasks count their own words, which are then added up. How
    many words are how frequent is looked at first, so that no more than ``most`` come to the driver, and no
    other words: those above a frequency. Words of equal counts go by letters, so reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            whole = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            lengths = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, last in row_groups(lengths, SLICE_BYTES):
                more = _counted(whole.slice(first, last - first), hashes[first:last])
                held = more if held is None else pa.concat_tables([held, more])
                if held.num_rows > COUNTED_AT_ONCE:
                    held = _again(held)
                    if held.num_rows > COUNTED_AT_ONCE // 2:
                        yield from held.to_batches()
                        held = None
            give_back()
        if held is not None:
            yield from _again(held).to_batches()

    counted = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(run, "word string, n bigint, texts bigint").groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("texts").alias("texts"))
    counted = counted.where(F.bit_count("texts") >= MIN_TEXTS).select("word", "n")
    counted = materialize(counted, "words")
    # a step is a hundredth of a power of two, so there are a few thousand steps at most
    step = F.floor(100 * F.log2("n")).alias("step")
    least, seen = None, 0
    for r in sorted(counted.groupBy(step).count().collect(), key=lambda r: -r["step"]):
        if (seen := seen + r["count"]) > most:
            break
        least = r["step"]
    rows = [] if least is None else counted.where(step >= least).collect()
    frequent = [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]
    return {w: i + 1 for i, w in reversed(list(enumerate([*WORDS, *frequent])))}


def base_spans(text: str, assign: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; ``assign`` False if no such keyword is in the text."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN] if assign else []
    # a maximal run is long enough if it matches with the least length, and only then
    found += [(m.start(), m.end(), "access") for m in _LONG_ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_MIN - 4))
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)


def guessed_spans(text: str, base: list[tuple[int, int, str]], threshold: float = MIN_LOG10_GUESSES, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """Values in a credential context that cost at least ``threshold`` and lie in no base span; linear in the text.

    Contexts and base spans are walked together, as both are in order; values that end together are cut once.
    """
    out: list[tuple[int, int, str]] = []
    at, reach, run_end, cut_from, costs = 0, -1, -1, -1, []
    for m in CONTEXT.finditer(text):
        start = m.start(2)
        if start >= run_end:
            run_end, cut_from = VALUE.match(text, start).end(), -1
        end = run_end
        while end > start and text[end - 1] in "\"'`,;.)]}>":
            end -= 1
        while at < len(base) and base[at][0] <= start:  # how far the base spans reach that begin before
            reach, at = max(reach, base[at][1]), at + 1
        if end - start < 6 or end <= reach or (out and end <= out[-1][1]) or (m[1] is None and PROSE.fullmatch(text, start, end)):
            continue
        if cut_from < 0:
            cut_from, costs = start, suffix_costs(text[start:end], ranks)
        if costs[start - cut_from] >= threshold:
            out.append((start, end, "guess"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_spans(text: str, assign: bool = True, context: bool = True, ranks: dict[str, int] = RANK) -> tuple[list, list]:
    """The base spans, and all spans; by start, then base kinds as listed, then guessed values."""
    base = base_spans(text, assign)
    more = guessed_spans(text, base, ranks=ranks) if context else []
    return base, sorted(base + more, key=lambda s: (s[0], (*BASE_KINDS, "guess").index(s[2])))


def _scanned(texts: pa.Array, ranks: dict[str, int]) -> Iterator[tuple[str, list, list]]:
    """Text by text; the rare keywords are looked for in the whole batch first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    assign, context = (pc.match_substring_regex(texts, p).to_pylist() for p in (ANY_ASSIGN, ANY_CONTEXT))
    for i in range(len(texts)):
        text = texts[i].as_py()
        yield (text, *find_spans(text, assign[i], context[i], ranks))


def scan_secrets(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """doc_id, ``base`` and ``spans`` of every row: arrays of (start, end, kind) in code points.

    ``ranks`` are those of ``word_ranks`` over ``docs`` unless given. Null text counts as empty and has
    no spans; repeated rows are scanned alike; an empty table gives an empty result; other columns are
    not carried. Texts are scanned whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs) if ranks is None else ranks)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(as_rows(base), as_rows(spans)) for _, base, spans in _scanned(batch.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b for b, _ in found], span), pa.array([s for _, s in found], span)], names=["doc_id", "base", "spans"])

    array = "array<struct<start:bigint,end:bigint,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {array}, spans {array}")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones together, replaced by ``[secret]``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """The same rows and columns with secrets masked in ``text`` and ``n_chars`` counted anew.

    ``ranks`` as in ``scan_secrets``. Null text stays null; texts without secrets are unchanged; every
    row is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs) if ranks is None else ranks)
    schema = T.StructType(list(docs.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text")
            new = [masked(text, spans) if spans else text for text, _, spans in _scanned(old, shared.value)]
            new = [text if old[i].is_valid else None for i, text in enumerate(new)]
            columns = {name: batch.column(name) for name in schema.names} | {"text": pa.array(new, old.type)}
            if "n_chars" in columns:
                counts = [len(t) if t is not None else n for t, n in zip(new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
