"""Spelling variants: words one edit apart, each led to its much more frequent neighbour, by bit-sliced search.

The vocabulary is searched for all words at one inserted, deleted or replaced letter. Within a block of
words the index holds, for each (position, letter), a bitset over the words. All words of the block are
queries at once: reading a query letter by letter, word-parallel recurrences keep four bitsets, with the
position shifted by the length difference so far:

    zero     no error so far                   zero & at(i)
    replaced one letter replaced               replaced & at(i)  |  zero & not at(i)
    added    the word has one letter more      (added | zero) & at(i + 1)
    missing  the word has one letter less      missing & at(i - 1)  |  zero

where at(i) is the bitset of words whose position i holds the query's letter. Only the bitsets of three
positions are held at a time, so memory does not grow with the length of words.

Blocks come from Spark: two words at one edit, the shorter of length m, share their first or their last
floor(m / 2) letters. Every word is dealt to the groups of its halves, for m its own length and one less.
A group above ``LARGEST`` words is refined until none is: by the next letter, and, for the pairs that part
just there, by the rest of the word without that letter. Those last groups hold an alphabet of words at
most, so every group is bounded, no pair is lost and none is found twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import stored

LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in ``DAMAGED`` loses a letter.
DAMAGED = 97
SHORTEST, LEAST = 5, 3
#: A form is at least so many times as frequent as its variant.
RATIO = 2
#: Words of a group before it is refined, and of a block of small groups that are searched together.
LARGEST, BLOCK = 4096, 1024
FORWARD, BACKWARD = 0, 1
#: Which pairs a group is for: those that share its key; those with one letter replaced or added after the key.
SHARED, REPLACED, ADDED = 0, 1, 2
GROUP = ["way", "m", "depth", "what", "key"]


def vocabulary(docs: DataFrame, doc: str = "doc_id", text: str = "text", damaged: int = DAMAGED, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: words of ``shortest`` letters or more that occur ``least`` times or more in all texts.

    Words are runs of Latin letters, A-Z lower-cased. Where ``damaged`` divides the crc32 of ``<key>:<run>``,
    the letter at that number modulo the run's length is left out.
    """
    low = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.expr("left(run, int(pmod(h, char_length(run))))"), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = drawn.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _turned(way: Column, word: Column) -> Column:
    return F.when(way == FORWARD, word).otherwise(F.reverse(word))


def groups(words: DataFrame, shortest: int = SHORTEST, largest: int = LARGEST) -> DataFrame:
    """``word, n`` with the groups (``GROUP``) in which a word is searched and searches."""
    length = F.char_length("word")
    halves = F.array(*[F.struct(F.lit(w).alias("way"), (length - k).alias("m")) for w in (FORWARD, BACKWARD) for k in (0, 1)])
    rows = words.select("word", "n", F.explode(halves).alias("g")).select("word", "n", "g.way", "g.m").where(F.col("m") >= shortest)
    depth = F.floor(F.col("m") / 2).cast("int")
    rows = rows.select("word", "n", "way", "m", depth.alias("depth"), F.lit(SHARED).alias("what"), F.substring(_turned(F.col("way"), F.col("word")), F.lit(1), depth).alias("key"))
    rows = stored(rows, "spelling-groups")
    done = None
    while True:
        hot = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > largest).select(*GROUP)
        hot = stored(hot, "spelling-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(hot, GROUP, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        rows = rows.join(hot, GROUP, "left_semi")
        t = _turned(F.col("way"), F.col("word"))
        depth, short = F.col("depth"), F.char_length("word") == F.col("m")
        rest = F.concat(F.substring(t, F.lit(1), depth), F.substring(t, depth + 2, F.char_length("word")))  # without the letter after the key
        shared = F.struct((depth + 1).alias("depth"), F.lit(SHARED).alias("what"), F.substring(t, F.lit(1), depth + 1).alias("key"))
        replaced = F.struct(depth.alias("depth"), F.lit(REPLACED).alias("what"), rest.alias("key"))
        added = F.struct(depth.alias("depth"), F.lit(ADDED).alias("what"), F.when(short, t).otherwise(rest).alias("key"))
        # A key as long as the shorter words is shared by one of them and its extensions only.
        here = F.when(short & (depth < F.col("m")), F.array(shared, replaced, added)).when(depth < F.col("m"), F.array(shared, added)).otherwise(F.array(added))
        finer = rows.select("word", "n", "way", "m", F.explode(here).alias("g")).select("word", "n", "way", "m", "g.depth", "g.what", "g.key")
        small = finer.where(F.col("what") != SHARED)
        done = done.unionByName(stored(small, "spelling-parted"))
        rows = stored(finer.where(F.col("what") == SHARED), "spelling-groups")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, 0 after their ends, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max())), np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, sizes


def _packed(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    n = rows.shape[1]
    wide = np.zeros((rows.shape[0], -(-n // 64) * 64), bool)
    wide[:, :n] = rows
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def search(words: list[str], group: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, word) one edit apart that are in one group, as indices; of each group's words, ``short`` tells
    those of the smaller length from those with a letter more. Pairs of two longer words are not looked for."""
    letters, sizes = _letters(words)
    alphabet, codes = np.unique(letters, return_inverse=True)
    codes = codes.reshape(letters.shape)
    if alphabet[0] != 0:
        codes, alphabet = codes + 1, np.append(np.uint32(0), alphabet)
    n, longest, size = len(words), letters.shape[1], len(alphabet)

    def index(i: int) -> np.ndarray:
        """The bitsets of all letters at position ``i``; none for "no letter"."""
        if not 0 <= i < longest:
            return np.zeros((size, -(-n // 64)), np.uint64)
        held = codes[:, i][None, :] == np.arange(size)[:, None]
        held[0] = False
        return _packed(held)

    names, owner = np.unique(group, return_inverse=True)
    mine = _packed(names[:, None] == group[None, :])[owner]
    is_short = _packed(short[None, :])
    same, longer, shorter = mine & is_short, mine & ~is_short, mine & is_short
    zero = np.full_like(mine, ~np.uint64(0))
    replaced, added, missing = np.zeros_like(zero), np.zeros_like(zero), np.zeros_like(zero)
    found = np.zeros_like(zero)
    before, here, after = index(-1), index(0), index(1)
    for i in range(longest + 1):
        over = np.flatnonzero(sizes == i)
        if len(over):
            s = short[over][:, None]
            found[over] = np.where(s, (replaced[over] & same[over]) | ((added[over] | zero[over]) & longer[over]), missing[over] & shorter[over])
        if i == longest:
            break
        c = codes[:, i]
        at = here[c]
        added = (added | zero) & after[c]
        missing = (missing & before[c]) | zero
        replaced = (replaced & at) | (zero & ~at)
        zero = zero & at
        before, here, after = here, after, index(i + 2)
    q, w = np.nonzero(found)
    bits = np.unpackbits(found[q, w][:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
    k, b = np.nonzero(bits)
    return q[k], w[k] * 64 + b


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))


def _found(rows: dict[str, np.ndarray | list[str]]) -> pa.RecordBatch:
    """Of a block of whole groups: for each word its near words there, counted, and the best of them."""
    words, n, way, m, depth, what, key = (rows[c] for c in ("word", "n", "way", "m", "depth", "what", "key"))
    turned = [x if w == FORWARD else x[::-1] for x, w in zip(words, way, strict=True)]
    names = {}
    group = np.array([names.setdefault(x, len(names)) for x in zip(way.tolist(), m.tolist(), depth.tolist(), what.tolist(), key, strict=True)])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    q, w = search(turned, group, sizes == m)
    if len(q):
        part = np.empty(len(q), np.int64)
        first = np.empty(len(q), np.int64)
        for shown, into in ((turned, part), (words, first)):
            letters, _ = _letters(shown)
            step = max(1, (1 << 24) // letters.shape[1])
            for a in range(0, len(q), step):
                into[a : a + step] = _shared(letters[q[a : a + step]], letters[w[a : a + step]])
        kind, same = what[q], sizes[q] == sizes[w]
        keep = (kind == SHARED) | ((part == depth[q]) & (same == (kind == REPLACED)))
        keep &= (way[q] == FORWARD) | (first < m[q] // 2)  # else the groups of the first halves have the pair
        q, w = q[keep], w[keep]
    rank = np.empty(len(words), np.int64)  # ties go to the smallest word
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[w], -n[w], q))
    q, w = q[order], w[order]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(q)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in q[head].tolist()], pa.string()), pa.array(count, pa.int64()), pa.array(n[w[head]], pa.int64()), pa.array([words[i] for i in w[head].tolist()], pa.string())],
        ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shortest: int = SHORTEST, largest: int = LARGEST, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` for the words that have near words: how many, and the most frequent."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def blocks(whole: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """Runs of whole groups with about ``block`` words and letters in proportion; what is left waits."""
            cols = [np.asarray(whole.column(c)) for c in GROUP[:4]]
            new = np.zeros(len(whole), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            keys = whole.column("key").to_pylist()
            new[1:] |= np.fromiter((a != b for a, b in zip(keys[1:], keys, strict=False)), bool, len(keys) - 1)
            heads = np.flatnonzero(new).tolist()
            out, a = [], 0
            for h in heads[1:]:
                # Lengths within a block are near each other, so that short words do not wait for long ones.
                if h - a >= block or cols[1][h] > 2 * cols[1][a]:
                    out.append(whole.slice(a, h - a))
                    a = h
            if last:
                return [*out, whole.slice(a)], whole.slice(0, 0)
            return out, whole.slice(a)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= 4 * block:
                ready, rest = blocks(pa.concat_tables(held).combine_chunks(), False)
                held = [rest]
                for x in ready:
                    yield _found({c: x.column(c).to_pylist() if c in ("word", "key") else np.asarray(x.column(c)) for c in x.column_names})
        if sum(map(len, held)):
            for x in blocks(pa.concat_tables(held).combine_chunks(), True)[0]:
                yield _found({c: x.column(c).to_pylist() if c in ("word", "key") else np.asarray(x.column(c)) for c in x.column_names})

    dealt = groups(words, shortest, largest).repartition(*GROUP).sortWithinPartitions(*GROUP)
    best = F.min(F.struct((-F.col("best_n")).alias("b"), F.col("best").alias("w")))
    return (dealt.mapInArrow(searched, "word string, n_near long, best_n long, best string")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.b")).alias("best_n"), F.col("x.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last. Every round doubles the steps taken; forms
    are ever more frequent, so chains are short and have no cycles."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", damaged: int = DAMAGED, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """One row for each word of the texts: ``word, n`` (occurrences), ``n_near`` (words one edit apart), ``form``
    (the most frequent of them, ties to the smallest in code-point order, if at least ``ratio`` times as
    frequent; else null), ``form_n``, and ``root`` (forms followed to the last; the word itself if it has none).

    Null texts hold no words; a null key counts as an empty one; repeated rows count as often as they stand
    there. Without words there are no rows.
    """
    words = stored(vocabulary(docs, doc, text, damaged, shortest, least), "spelling-words")
    near = near_words(words, shortest)
    is_form = F.col("best_n") >= ratio * F.col("n")
    led = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    led = stored(led, "spelling-forms")
    last = roots(led.where(F.col("form").isNotNull()))
    return led.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(done: DataFrame) -> DataFrame:
    return done.select("word", "form", "root", "n", "n_near", "form_n")
