"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

Base spans are what the patterns match; they always stay. Every run of 12 or more token characters
that mixes letters and digits is a candidate besides. The network reads the characters of a candidate
and of its surroundings. It is trained in numpy, on what the patterns found (secrets; of an assignment the
value, with the keyword before it) and on ordinary long words and tokens made of words of the texts and
short numbers (no secrets): every finding, and one of each from every text that has them. Candidates have no
label and are not trained on. As they stand in plain text, findings are also shown in the
surroundings of the others, and behind their characters. One row in ``HELD`` is held back to calibrate the scores (Platt) and to set the threshold: the
highest that still finds ``RECALL`` of the held-back secrets; both are over all rows held back. Every candidate of the corpus is scored,
over its whole length: a candidate longer than ``BODY`` characters is read in frames of that size that
overlap by half or more, and the best of them counts. Of a longer row to learn from one frame is
learnt, chosen by a hash; the finding's own score is never below it, so the recall holds.

Training is spread over shards of about ``SHARD`` rows, dealt by a hash: in each of ``ROUNDS`` rounds every
shard goes on from the common weights over all its rows, and the new weights are the mean of the shards'.
The sums of the calibration and the threshold's rank are Spark aggregates and sorts.

The texts are read once; findings and candidates with their surroundings are stored, and training
and scoring read those.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import chunks, share, stored, taken

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs of hexadecimal digits; shorter ones would be dropped and need no visit.
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
WORD = re.compile(r"[^\W\d_]{12,}")
KEYS = (b"passw", b"secret", b"token", b"api", b"AKIA")
LEFT, BODY, RIGHT = 16, 48, 8
STEP, FRAMES = BODY // 2, 4096  # between frames; frames scored at once
RECALL, HELD = 0.95, 4
SHARD, ROUNDS, EPOCHS = 8192, 3, 6  # rows that train together; rounds of several shards, a pass each; passes of a single one
FILTERS, WIDTH, DIM = 32, 5, 8
NOT_A_SECRET, MADE = -1, -2  # an ordinary word, and a token made of ordinary words; for training only
ASCII_WORD = re.compile(r"(?<![^\W_])[A-Za-z]{2,20}(?![^\W_])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates: tokens with letters and digits that no base span overlaps."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    k = 0
    for m in TOKEN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if any(s < m.end() and m.start() < e for s, e in taken[k : k + 3]):
            continue
        x = m.group()
        if any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
            out.append((3, m.start(), m.end()))
    return out


def made(text: str) -> tuple[int, int, str] | None:
    """(start, end, token): a token of letters and digits that is no secret, as it is made of words that
    follow each other in the text and of short numbers, with the place of these words."""
    near = list(islice(ASCII_WORD.finditer(text, len(text) // 3), 8))
    if not near:
        return None
    r = random.Random(zlib.crc32(text[near[0].start() : near[-1].end()].encode()))
    near = near[: r.randrange(1, 9)]
    words = [r.choice((str.lower, str.lower, str.capitalize, str.upper))(m.group()) for m in near]
    number = r.choice((str(r.randrange(10)), str(r.randrange(100)), str(r.randrange(1900, 2100)), f"{r.randrange(1, 13):02d}", f"{r.randrange(10**6):06d}"))
    day = f"{r.randrange(1990, 2040)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    mark = r.choice("_-/_-/=+")
    parts = r.choice(([*words, number], [number, *words], [words[0], number, *words[1:]], [day, *words], [*words, day]))
    token = r.choice((mark, mark, "")).join(parts) if len(words) < 4 else mark.join(parts)
    while len(token) < 12:
        token += mark + r.choice(words) + r.choice(("", str(r.randrange(100))))
    return near[0].start(), near[-1].end(), r.choice(("", "", "/")) + token


def suspects(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the texts that hold a digit or a long run of hexadecimal digits."""
    digit = (raw >= 0x30) & (raw <= 0x39)
    run = np.concatenate([[0], np.cumsum(digit | ((raw >= 0x61) & (raw <= 0x66)), dtype=np.int64)])
    long = np.flatnonzero(run[16:] - run[:-16] == 16) if len(raw) >= 16 else np.zeros(0, np.int64)
    return np.unique(np.searchsorted(at, np.concatenate([np.flatnonzero(digit), long]), "right") - 1)


def frames(left: str, body: str, right: str) -> Iterator[tuple[str, str, str]]:
    """The whole of ``body`` in overlapping frames of ``BODY`` characters, each with its surroundings."""
    last = max(0, len(body) - BODY)
    for a in [*range(0, last, STEP), last]:
        z = a + BODY
        yield (left + body[:a] if a < LEFT else body[a - LEFT : a])[-LEFT:], body[a:z], (body[z : z + RIGHT] + right)[:RIGHT]


def framed(left: str, body: str, right: str) -> dict[str, str]:
    """One of the frames, chosen by a hash."""
    last = max(0, len(body) - BODY)
    pick = zlib.crc32(body.encode()) % (-(-last // STEP) + 1)
    return dict(zip(("left", "body", "right"), next(islice(frames(left, body, right), pick, None)), strict=True))


def found(docs: DataFrame, share: Column) -> DataFrame:
    """(doc, spans) for each row of (doc, text): base spans, candidates and, in the rows where
    ``share`` holds, an ordinary word and a made token, each with its characters and surroundings. The
    characters of an assignment are its value's; the keyword is among its surroundings. Candidates are
    whole, all others one frame."""
    item = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string())])

    def shown(text: str, c: int, s: int, e: int, body: str | None = None) -> dict:
        b = ASSIGN.match(text, s).start(2) if c == 0 else s
        parts = text[max(0, b - LEFT) : b], text[b:e] if body is None else body, text[e : e + RIGHT]
        return {"kind": c, "s": s, "e": e} | (dict(zip(("left", "body", "right"), parts, strict=True)) if c == 3 else framed(*parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in chunks(batch, "text"):
                data, out = raw.tobytes(), []
                told = np.zeros(rows.num_rows, bool)
                told[suspects(raw, at)] = True
                picked = rows.column("pick").to_pylist()
                for k in range(rows.num_rows):
                    own = data[at[k] : at[k + 1]]
                    spans: list[tuple[int, int, int]] = []
                    extra = []
                    low = own.lower()
                    if told[k] or KEYS[-1] in own or any(x in low for x in KEYS[:-1]):
                        text = own.decode()
                        spans = base_spans(text)
                        spans += candidates(text, spans)
                    if picked[k]:
                        text = own.decode()
                        word = WORD.search(text, len(text) // 3)
                        spans += [(NOT_A_SECRET, word.start(), word.end())] if word else []
                        if token := made(text):
                            extra = [shown(text, MADE, *token)]
                    out.append([shown(text, *x) for x in spans] + extra)
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(out, pa.list_(item))], ["doc", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "s", "e")] + [T.StructField(n, T.StringType()) for n in ("left", "body", "right")]))
    return docs.withColumn("pick", share).mapInArrow(run, T.StructType([T.StructField("doc", docs.schema["doc"].dataType), T.StructField("spans", kind)]))


def characters(left: list[str], body: list[str], right: list[str]) -> np.ndarray:
    """Character numbers (0: none, 96: beyond ASCII) in fixed columns: before, candidate, after."""
    out = np.zeros((len(body), LEFT + BODY + RIGHT), np.int64)
    for k, (a, b, c) in enumerate(zip(left, body, right, strict=True)):
        for text, col in ((a, LEFT - len(a)), (b, LEFT), (c, LEFT + BODY)):
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            out[k, col : col + len(points)] = np.where((points >= 32) & (points < 127), points - 31, 96)
    return out


class Network:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, one output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (97, DIM)), "conv": r.normal(0, 0.2, (WIDTH * DIM, FILTERS)), "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, 2 * FILTERS), "last": np.zeros(1),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, 1.0
        places = LEFT + BODY + RIGHT - WIDTH + 1
        self.inside = np.zeros(places, bool)
        self.inside[LEFT - WIDTH // 2 : LEFT + BODY - WIDTH // 2] = True

    def forward(self, x: np.ndarray) -> tuple:
        e = self.p["embed"][x]
        e[x == 0] = 0
        places = x.shape[1] - WIDTH + 1
        cols = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), WIDTH * DIM, axis=1)[:, ::DIM].reshape(-1, WIDTH * DIM)
        h = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0).reshape(len(x), places, FILTERS)
        cols = cols.reshape(len(x), places, WIDTH * DIM)
        by = np.ascontiguousarray(h.transpose(0, 2, 1))  # places side by side, for the maxima
        z = np.flatnonzero(self.inside)[-1] + 1
        a = z - int(self.inside.sum())
        ia = by[:, :, a:z].argmax(axis=2) + a
        left, right = by[:, :, :a].argmax(axis=2), by[:, :, z:].argmax(axis=2) + z
        n, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        ib = np.where(h[n, right, f] > h[n, left, f], right, left)
        pooled = np.concatenate([h[n, ia, f], h[n, ib, f]], axis=1)
        return pooled @ self.p["out"] + self.p["last"][0], pooled, cols, ia, ib

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        z, pooled, cols, ia, ib = self.forward(x)
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        g = {"out": pooled.T @ d, "last": d.sum(keepdims=True)}
        back = d[:, None] * self.p["out"] * (pooled > 0)
        n, f = np.arange(len(x))[:, None], np.broadcast_to(np.arange(FILTERS), (len(x), FILTERS))
        dh = np.zeros((*cols.shape[:2], FILTERS))
        dh[n, ia, f] = back[:, :FILTERS]  # no place is inside and outside
        dh[n, ib, f] = back[:, FILTERS:]
        g["conv"] = np.tensordot(cols, dh, axes=([0, 1], [0, 1]))
        g["bias"] = dh.sum(axis=(0, 1))
        dc = dh @ self.p["conv"].T
        dx = np.zeros((*x.shape, DIM))
        for k in range(WIDTH):
            dx[:, k : k + cols.shape[1]] += dc[:, :, k * DIM : (k + 1) * DIM]
        de = np.stack([np.bincount(x.ravel(), dx[:, :, k].ravel(), 97) for k in range(DIM)], axis=1)
        de[0] = 0
        g["embed"] = de
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x_) for k, x_ in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                pick, t = order[i : i + batch], t + 1
                for k, g in self.gradients(x[pick], y[pick], weight[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall."""
        z = self.margins(x)
        n, size = int(y.sum()), max(float(np.abs(z).max()), 1e-6)

        def sums(a: float, b: float) -> tuple:
            u = z / size
            m = a * u + b
            p = 1 / (1 + np.exp(-m))
            d, s = p - np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2)), p * (1 - p)
            return (np.logaddexp(0, m) - m * (p - d)).sum(), (d * u).sum(), d.sum(), (s * u * u).sum(), (s * u).sum(), s.sum()

        self.platt(sums, n, len(y) - n, size)
        own = np.sort(self.scores(x[y > 0]))
        self.threshold = float(own[int((1 - recall) * len(own) + 1e-9)])

    def platt(self, sums: Callable[[float, float], tuple], n: int, others: int, size: float) -> None:
        """Slope and offset by Newton steps. ``sums(a, b)``: over all margins divided by ``size``, the loss and its first
        and second derivatives (a, b; aa, ab, bb)."""
        a, b = 0.0, float(np.log((n + 1) / (others + 1)))
        at = sums(a, b)
        for _ in range(50):
            _, ga, gb, aa, ab, bb = at
            da, db = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-9]]), np.array([ga + 1e-3 * a, gb]))
            step, here = 1.0, at[0] + 5e-4 * a * a
            while True:
                to = a - step * da, b - step * db
                at = sums(*to)
                if step <= 1e-3 or at[0] + 5e-4 * to[0] ** 2 <= here + 1e-9 * abs(here):  # equal but for rounding
                    break
                step /= 2
            a, b = to
            if abs(da) + abs(db) < 1e-6 * (1 + abs(a) + abs(b)):
                break
        self.slope, self.offset = float(a) / size, float(b)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.margins(x))

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, weights: np.ndarray) -> Network:
        """The network with these ``weights``."""
        a = 0
        for k, v in self.p.items():
            self.p[k], a = np.array(weights[a : a + v.size], float).reshape(v.shape), a + v.size
        return self

    def best(self, left: list[str], body: list[str], right: list[str]) -> np.ndarray:
        """Each whole candidate's score: the highest of its frames."""
        out = np.zeros(len(body))
        every = ((k, x) for k, parts in enumerate(zip(left, body, right, strict=True)) for x in frames(*parts))
        while block := list(islice(every, FRAMES)):
            own, parts = zip(*block, strict=True)
            np.maximum.at(out, np.array(own), self.scores(characters(*map(list, zip(*parts, strict=True)))))
        return out


def fit(spans: DataFrame, recall: float = RECALL) -> Network | None:
    """The network trained and calibrated on all rows; none where there are too few findings or nothing else."""
    rows = spans.select("doc", F.explode("spans").alias("x")).select("doc", "x.*").where("kind <> 3")
    place = F.xxhash64(F.col("doc").cast("string"), "s", "kind", "left", "body", F.lit(5))
    # Rows of equal characters go to the same side, so that copies of a finding do not calibrate what they trained.
    rows = rows.select(F.col("kind").between(0, 2).alias("secret"), "left", "body", "right", place.alias("h"), (F.pmod(F.xxhash64("body"), F.lit(HELD)) == 0).alias("held"))
    rows = stored(rows, "learnt")

    def sizes(of: DataFrame) -> dict:
        return {(r.held, r.secret): r["count"] for r in of.groupBy("held", "secret").count().collect()}

    sides = [(h, s) for h in (False, True) for s in (False, True)]
    n = sizes(rows)
    if min(n.get((False, s), 0) + n.get((True, s), 0) for s in (False, True)) < 4 * HELD:
        return None
    if min(n.get(k, 0) for k in sides) < 2:
        rows = rows.withColumn("held", F.pmod("h", F.lit(HELD)) == 0)
        n = sizes(rows)
        if min(n.get(k, 0) for k in sides) < 1:
            return None
    sharded = [_sharded(rows.where(F.col("held") == h), n[h, False] + n[h, True]) for h in (False, True)]
    net, rounds = Network(), ROUNDS if sharded[0][1] > 1 else 1
    for k in range(rounds):
        net.put(_trained(sharded[0][0], net, 1 if rounds > 1 else EPOCHS, 7 + k))
    _calibrated(net, sharded[1][0], recall)
    return net


def _sharded(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rows with the shard of about ``SHARD`` rows that each belongs to, and the number of shards."""
    shards = max(1, round(n / SHARD))
    return rows.withColumn("shard", F.pmod("h", F.lit(shards))), shards


def _numbers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A shard's characters and labels, in an order that does not depend on how Spark dealt the rows."""
    pdf = pdf.sort_values(["h", "body", "left", "right"])
    return characters(*(pdf[c].tolist() for c in ("left", "body", "right"))), pdf["secret"].to_numpy(np.float64)


def _trained(rows: DataFrame, net: Network, epochs: int, seed: int) -> np.ndarray:
    """The mean of the weights of all shards, each trained on its rows from those of ``net``."""
    weights = share(rows.sparkSession, net.weights())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Network().put(taken(weights))
        own.train(*_moved(*_numbers(pdf)), epochs=epochs, seed=seed)
        return pd.DataFrame({"w": [own.weights()]})

    # Sums of whole numbers do not depend on their order.
    parts = rows.groupBy("shard").applyInPandas(run, "w array<double>").select(F.posexplode("w").alias("k", "w"))
    means = parts.groupBy("k").agg((F.sum(F.round(F.col("w") * (1 << 40)).cast("decimal(20,0)")).cast("double") / F.count(F.lit(1)) / (1 << 40)).alias("w"))
    return np.array([r.w for r in means.orderBy("k").collect()])  # bounded: one number per weight


def _calibrated(net: Network, rows: DataFrame, recall: float) -> None:
    """Platt scaling and the threshold of ``net``, over all rows."""
    weights = share(rows.sparkSession, net.weights())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _moved(*_numbers(pdf))
        return pd.DataFrame({"secret": y > 0, "z": Network().put(taken(weights)).margins(x)})

    held = stored(rows.groupBy("shard").applyInPandas(run, "secret boolean, z double"), "margins")
    total = held.agg(F.count_if("secret").alias("n"), F.count(F.lit(1)).alias("all"), F.max(F.abs("z")).alias("size")).first()
    n, others, size = total["n"], total["all"] - total["n"], max(total["size"], 1e-6)
    goal = F.when(F.col("secret"), F.lit((n + 1) / (n + 2))).otherwise(F.lit(1 / (others + 2)))

    def sums(a: float, b: float) -> tuple:
        u = F.col("z") / size
        m = u * a + b
        p = 1 / (1 + F.exp(-m))
        d, s = p - goal, p * (1 - p)
        loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - goal * m
        return tuple(held.agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate((loss, d * u, d, s * u * u, s * u, s))]).first())

    net.platt(sums, n, others, size)
    order = F.col("z").asc() if net.slope >= 0 else F.col("z").desc()
    at = held.where("secret").select("z").orderBy(order).offset(int((1 - recall) * n + 1e-9)).limit(1).first().z
    net.threshold = float(net.scaled(np.array([at]))[0])


def _moved(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Adds the findings with digits in the surroundings of other rows, and there after the first characters of
    such a row's token. A shard without findings or without others stays as it is."""
    r = np.random.default_rng(seed)
    found, other = x[y > 0], x[y == 0]
    body = found[:, LEFT : LEFT + BODY]
    found = found[((body >= 17) & (body <= 26)).any(axis=1)]
    if not len(found) or not len(other):
        return x, y
    bare = found.copy()
    at = other[r.integers(0, len(other), len(found))]
    bare[:, :LEFT], bare[:, LEFT + BODY :] = at[:, :LEFT], at[:, LEFT + BODY :]
    after = bare.copy()
    for k, n in enumerate(r.integers(1, BODY // 2, len(after))):
        n = min(int(n), int((at[k, LEFT : LEFT + BODY] > 0).sum()))
        after[k, LEFT : LEFT + n] = at[k, LEFT : LEFT + n]
        after[k, LEFT + n : LEFT + BODY] = bare[k, LEFT : LEFT + BODY - n]
    return np.concatenate([x, bare, after]), np.concatenate([y, np.ones(2 * len(found))])


def secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base spans by kind and listed, and all spans
    listed, those of kind ``model`` among them.

    One row for each input row, repeated ones too; null and empty texts have no spans. Other columns
    are not read. With too few findings to train on, nothing is added.
    """
    source = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    spans = stored(found(source, F.lit(True)), "findings")
    shared = share(docs.sparkSession, fit(spans, recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = taken(shared)
        for batch in batches:
            lists = [x or [] for x in batch.column("spans").to_pylist()]
            own = [(k, x) for k, xs in enumerate(lists) for x in xs if x["kind"] == 3]
            good: dict[int, list[tuple[int, int, int]]] = {}
            if net and own:
                score = net.best(*([x[c] for _, x in own] for c in ("left", "body", "right")))
                for (k, x), s in zip(own, score.tolist(), strict=True):
                    if s >= net.threshold:
                        good.setdefault(k, []).append((x["s"], 3, x["e"]))
            base = [sorted((x["s"], x["kind"], x["e"]) for x in xs if 0 <= x["kind"] <= 2) for xs in lists]
            every = [sorted(b + good.get(k, [])) for k, b in enumerate(base)]
            listed = [[",".join(f"{KINDS[c]}:{s}:{e}" for s, c, e in row) for row in rows] for rows in (base, every)]
            counts = [pa.array([sum(c == k for _, c, _ in b) for b in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *counts, pa.array(listed[0], pa.string()), pa.array(listed[1], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema[doc].dataType
    return spans.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
