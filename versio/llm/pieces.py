"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, led by a space, is read over the lattice of all vocabulary pieces that its characters spell.
A segmentation has the probability prod p(piece) ** alpha, up to a factor; a piece's p follows its
rank r in the vocabulary by Zipf's law, 1 / ((r + 2) * H), as a BPE vocabulary states ranks only.
Forward filtering sums the segmentations of every prefix; backward sampling then draws the last
piece, the one before it and so on, each with its exact probability. The draws are hashes of the
row's key and the position, so a row's segmentation is the same in any batch, task or rerun.

No piece spans a line break or a space after other characters, so texts are cut there into units; the
lattice of each distinct unit of a batch is filtered once, all in numpy, and all units of the batch
are sampled together. Characters without a piece become their UTF-8 bytes' pieces, a literal
lower-one-eighth block (the vocabulary's space mark) among them; that keeps decoding lossless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import chunks, mix64, share, taken

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 0.3, 1
SPACE = "▁"
UNIT = re.compile(" +[^ \n]*|\n|[^ \n]+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 21
#: Text bytes whose lattices are held at once; they take about a hundred times as much memory.
AT_ONCE = 1 << 20


class Pieces:
    """A vocabulary as a trie in numpy tables; its size bounds what is sent to the tasks."""

    def __init__(self, model: str, alpha: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_at = np.zeros(256, np.int32)
        self.text: list[bytes] = [b""] * n
        spelled: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at[value], self.text[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                spelled[piece.replace(SPACE, " ")] = i
                self.text[i] = piece.replace(SPACE, " ").encode()
        if any("\n" in p or " " in p.lstrip(" ") for p in spelled):
            raise ValueError("a piece spans a line break or a space after other characters")
        order = {p: r for r, p in enumerate(sorted(spelled, key=lambda p: (spelled[p])))}
        total = np.log(np.sum(1 / (np.arange(len(order) + 1) + 2)))
        letters = sorted({c for p in spelled for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.size = n  # as a piece number: the UTF-8 bytes of one character
        states: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for p, i in spelled.items():
            s = 0
            for c in p:
                key = (s, int(self.letter[ord(c)]))
                if key not in states:
                    states[key] = len(ends)
                    ends.append(-1)
                s = states[key]
            ends[s] = i
        self.ends = np.array(ends, np.int32)
        self.depth = max(map(len, spelled))
        self.weight = np.zeros(n + 1)
        for p, i in spelled.items():
            self.weight[i] = -alpha * (np.log(order[p] + 2) + total)
        self.weight[n] = -alpha * (np.log(len(order) + 2) + total)
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.next = np.zeros(1 << TABLE_BITS, np.int32)
        for (s, c), t in states.items():
            at = self._slot(np.array([s << 20 | c]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = s << 20 | c, t
        sizes = np.array([len(x) for x in self.text])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.spelling = np.frombuffer(b"".join(self.text), np.uint8)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The trie's next state for each pair, 0 for none."""
        want = state.astype(np.int64) << 20 | letter
        at = self._slot(want)
        got = self.keys[at]
        out = np.where(got == want, self.next[at], 0)
        again = np.flatnonzero((got != want) & (got >= 0))
        while len(again):
            at[again] = (at[again] + 1) % len(self.keys)
            got = self.keys[at[again]]
            hit = got == want[again]
            out[again[hit]] = self.next[at[again[hit]]]
            again = again[~hit & (got >= 0)]
        return out

    def lattice(self, letters: np.ndarray, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering over units end to end. Node k of a unit at offset o is o + k + its number
        (one node more than letters each). Gives (first edge of each node, edge's length, its piece,
        its cumulative probability among the node's edges); edges are listed by the node they end in."""
        n, unit = len(letters), np.repeat(np.arange(len(size)), size)
        stop = (offset + size)[unit]
        at, state = np.arange(n), np.zeros(n, np.int64)
        single = np.zeros(n, bool)
        begin, length, piece = [], [], []
        for k in range(self.depth):
            inside = at + k < stop[at]
            at, state = at[inside], state[inside]
            state = self.step(state, letters[at + k])
            on = state > 0
            at, state = at[on], state[on]
            if not len(at):
                break
            end = self.ends[state]
            hit = end >= 0
            if k == 0:
                single[at[hit]] = True
            begin.append(at[hit])
            length.append(np.full(int(hit.sum()), k + 1, np.int32))
            piece.append(end[hit])
        rest = np.flatnonzero(~single)
        begin.append(rest)
        length.append(np.ones(len(rest), np.int32))
        piece.append(np.full(len(rest), self.size, np.int32))
        b, ln, pc = np.concatenate(begin), np.concatenate(length), np.concatenate(piece)
        del begin, length, piece
        node = b + unit[b]
        target = node + ln
        order = np.argsort(target, kind="stable")
        node, target, ln, pc = node[order], target[order], ln[order], pc[order]
        nodes = n + len(size)
        first = np.searchsorted(target, np.arange(nodes + 1))
        # By the number of letters before the target: every edge's begin is done before its end.
        depth = target - (offset + np.arange(len(size)))[np.searchsorted(offset + np.arange(len(size)), target, "right") - 1]
        rank = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[rank], np.arange(1, int(size.max(initial=0)) + 2))
        ahead = np.zeros(nodes)
        odds = np.zeros(len(ln))
        w = self.weight[pc]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            e = rank[a:z]  # sorted by target, as rank is stable
            x = ahead[node[e]] + w[e]
            t = target[e]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            top = np.maximum.reduceat(x, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(e))))
            p = np.exp(x - top[group])
            total = np.add.reduceat(p, head)
            ahead[t[head]] = top + np.log(total)
            odds[e] = p / total[group]
        run = np.cumsum(odds)
        base = np.concatenate([[0.0], run])[first[target]]
        return first, ln, pc, run - base

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets) of one sampled segmentation of each text."""
        known: dict[str, int] = {}
        units: list[int] = []
        chars = np.zeros(len(texts) + 1, np.int64)
        whole = [" " + t if t else "" for t in texts]
        number = known.setdefault
        for k, t in enumerate(whole):
            chars[k + 1] = len(t)
            units += [number(u, len(known)) for u in UNIT.findall(t)]
        chars = np.cumsum(chars)
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        names = list(known)
        size = np.fromiter(map(len, names), np.int64, len(names))
        offset = np.cumsum(size) - size
        first, length, piece, chance = self.lattice(self.letter[np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)], offset, size)
        own = np.array(units)
        pos = np.cumsum(size[own])
        node = (offset + np.arange(len(names)) + size)[own]
        low = node - size[own]
        doc = np.searchsorted(chars, pos - 1, "right") - 1
        seed = seeds[doc] - chars[doc].astype(np.uint64) * GOLDEN
        found = np.full(int(chars[-1]) + 1, -1, np.int32)
        while len(node):
            draw = (mix64(seed + pos.astype(np.uint64) * GOLDEN) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            e, last = first[node], first[node + 1] - 1
            go = np.flatnonzero((chance[e] <= draw) & (e < last))
            while len(go):
                e[go] += 1
                go = go[(chance[e[go]] <= draw[go]) & (e[go] < last[go])]
            found[pos] = piece[e]
            back = length[e]
            node, pos = node - back, pos - back
            on = node > low
            node, pos, low, seed = node[on], pos[on], low[on], seed[on]
        at = np.flatnonzero(found >= 0)
        ids = found[at]
        points = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)[at - 1]
        many = np.where(ids < self.size, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        out = np.repeat(ids, many)
        starts = np.cumsum(many) - many
        for k in np.flatnonzero(ids == self.size).tolist():
            out[starts[k] : starts[k] + many[k]] = self.bytes_at[np.frombuffer(chr(points[k]).encode(), np.uint8)]
        return out, np.append(starts, len(out))[np.searchsorted(at, chars, "right")]

    def spell(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decodes ids end to end: (UTF-8 bytes, offsets), without each text's leading space."""
        size = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)
        raw = self.spelling[source]
        cuts = np.concatenate([[0], ends])[at]
        keep = np.ones(total, bool)
        keep[cuts[:-1][cuts[1:] > cuts[:-1]]] = False
        return raw[keep], cuts - np.concatenate([[0], np.cumsum(cuts[1:] > cuts[:-1])])


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` with ``sp_ids``, the ids of a sampled segmentation, and ``sp_lossless``: decoding them
    gave the text.

    A null text has null ids, an empty one an empty list. Rows with equal key and text, repeated rows
    among them, get equal ids; a null key is a key like others. Columns ``sp_*`` are replaced, all others stay.
    """
    shared = share(docs.sparkSession, Pieces(model, alpha))
    docs = docs.drop("sp_ids", "sp_lossless", "sp_seed")
    fields = [*docs.schema.fields, T.StructField("sp_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("sp_lossless", T.BooleanType())]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = taken(shared)
        for batch in batches:
            for rows, raw, at in chunks(batch, text, AT_ONCE):
                texts = [x or "" for x in rows.column(text).to_pylist()]
                ids, cuts = pieces.sample(texts, rows.column("sp_seed").to_numpy().view(np.uint64))
                back, ends = pieces.spell(ids, cuts)
                same = np.diff(ends) == np.diff(at)
                if not (same.all() and len(back) == len(raw) and (back == raw).all()):
                    same = [back[ends[k] : ends[k + 1]].tobytes() == raw[at[k] : at[k + 1]].tobytes() for k in range(rows.num_rows)]
                null = np.append(np.asarray(rows.column(text).is_null()), False)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32), pa.int32(), mask=null), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), lists, pa.array(same, pa.bool_())], [*names, "sp_ids", "sp_lossless"])

    seeded = docs.withColumn("sp_seed", F.xxhash64(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.col(doc).isNull(), F.lit(seed)))
    return seeded.mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, ids: str = "sp_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text that the ids spell; null for null ids."""
    shared = share(tokens.sparkSession, Pieces(model, 1.0))
    tokens = tokens.drop(out)
    names = [*tokens.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = taken(shared)
        for batch in batches:
            lists = batch.column(ids)
            values = [np.asarray(x if x is not None else [], np.int64) for x in lists.to_pylist()]
            cuts = np.cumsum([0, *map(len, values)])
            raw, at = pieces.spell(np.concatenate([np.zeros(0, np.int64), *values]), cuts)
            data = raw.tobytes()
            texts = [data[a:z].decode("utf-8", "replace") if v else None for a, z, v in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())]))


def digest(done: DataFrame, doc: str = "doc_id") -> DataFrame:
    return done.select(F.col(doc).alias("doc_id"), F.coalesce(F.size("sp_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("sp_ids").alias("ids"), F.col("sp_lossless").alias("lossless"))


