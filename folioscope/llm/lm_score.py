"""Language-model scores: a gated recurrent network in numpy with a class-factored softmax.

Words are counted over the whole training corpus. The network predicts the most frequent ``vocab`` words, the end of a
text, and for all other words one of ``shapes`` buckets of their last bytes; within a bucket a word has its share of
the bucket's count, one share being kept for words never seen. The softmax is factored: first the class, then the
member. Training is truncated backpropagation over parallel streams of documents; trainers work on parts of the corpus
and their parameters are averaged, in two steps, so the driver gets a fixed number of parameter sets. Scoring carries
the state through the whole text, window by window.

The base score and the shares inside buckets need the count of every word, which no process has to hold: the frequent
words are broadcast (a fixed number), the others are joined to the counts, a row for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import gathered, materialize, ship, split_words, table, trim, values

if TYPE_CHECKING:  # workers do without it
    import pandas as pd

END = b"\n"  # stands for the end of a text: no word holds white space
SEQ = np.int16  # ids of a text
TOP = np.float32(60)  # no logit is larger: its exponential stays in range
BLOCK = 1024  # rows of a softmax that are worked on at once
TAIL = 3  # a bucket goes by so many last bytes


def bucket(word: bytes, shapes: int) -> int:
    return zlib.crc32(word[-TAIL:]) % shapes


@dataclass
class Layout:
    """Ids of the network: words by frequency, then the end, then the buckets; and their classes."""

    words: list[bytes]
    shapes: int
    class_of: np.ndarray
    member_of: np.ndarray
    sizes: np.ndarray

    @property
    def end(self) -> int:
        return len(self.words)

    def __len__(self) -> int:
        return len(self.words) + 1 + self.shapes


def layout(words: list[bytes], counts: list[int], shapes: int, classes: int) -> Layout:
    """Classes of about equal size along the order of frequency; the end has a class of its own, buckets share theirs."""
    n = len(words)
    per = max(1, -(-n // max(1, classes)))
    group = [i // per for i in range(n)]
    after = group[-1] + 1 if group else 0
    per = max(1, int(round(shapes**0.5)))
    group += [after, *(after + 1 + i // per for i in range(shapes))]
    class_of = np.array(group, np.int32)
    sizes = np.bincount(class_of)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]])
    return Layout(words, shapes, class_of, (np.arange(len(group)) - first[class_of]).astype(np.int32), sizes)


class Network:
    """h' = (1 - z) n + z h, with gates from a row for each input word and the last state.

    The parameters lie in one vector, ``flat``; ``p`` has views of it by name.
    """

    def __init__(self, lay: Layout, hidden: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        classes, most = len(lay.sizes), int(lay.sizes.max())
        self.lay, self.hidden = lay, hidden
        self.shapes = {"x": (len(lay), 3 * hidden), "u": (hidden, 3 * hidden), "c": (hidden, classes), "cb": (classes,), "w": (classes, hidden, most), "wb": (classes, most)}
        self.load(np.zeros(sum(int(np.prod(n)) for n in self.shapes.values()), np.float32))
        for name, scale in (("x", 0.1), ("u", hidden**-0.5), ("c", 0.1), ("w", 0.1)):
            self.p[name][...] = rng.standard_normal(self.shapes[name]) * scale
        self.p["wb"][...] = np.where(np.arange(most) < lay.sizes[:, None], 0, -1e4)

    def load(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.p = self.views(flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def bias(self, counts: np.ndarray) -> None:
        """Starts from the unigrams."""
        lay, n = self.lay, counts + 1.0
        per = np.bincount(lay.class_of, n)
        self.p["cb"][...] = np.log(per / per.sum())
        self.p["wb"][lay.class_of, lay.member_of] = np.log(n / per[lay.class_of])

    def step(self, g: np.ndarray, h: np.ndarray, z_r: np.ndarray, n: np.ndarray, un: np.ndarray, out: np.ndarray) -> None:
        """Next state into ``out`` from the input rows ``g`` (which it uses up) and the state ``h``; keeps both gates, the
        proposal ``n`` and its recurrent part ``un``."""
        k = self.hidden
        a = h @ self.p["u"]
        np.add(g[:, : 2 * k], a[:, : 2 * k], out=z_r)
        np.negative(z_r, out=z_r)
        np.minimum(z_r, TOP, out=z_r)
        np.exp(z_r, out=z_r)
        z_r += 1
        np.reciprocal(z_r, out=z_r)
        un[...] = a[:, 2 * k :]
        np.multiply(z_r[:, k:], un, out=n)
        n += g[:, 2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= z_r[:, :k]
        out += n

    def output(self, h: np.ndarray, want: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each wanted id; with ``grads`` also the gradient of the negative sum by h.

        Rows are sorted by class, so that each class has a stretch of them; large stretches go in blocks that fit a cache.
        """
        lay, p = self.lay, self.p
        # states lie within -1 and 1, which bounds the logits: where that is small enough no exponential can overflow
        tame = max(float((np.abs(p["c"]).sum(axis=0) + p["cb"]).max()), float((np.abs(p["w"]).sum(axis=1) + p["wb"]).max())) < TOP
        c = lay.class_of[want]
        order = np.argsort(c.astype(np.uint16), kind="stable")
        h, c, m = h[order], c[order], lay.member_of[want[order]]
        out = np.empty(len(h), np.float32)
        dh = np.empty_like(h) if grads is not None else None
        rows = np.arange(BLOCK)

        def softmax(at: slice, w: np.ndarray, b: np.ndarray, own: np.ndarray, gw: np.ndarray | None, gb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
            x = h[at] @ w
            x += b
            if not tame:
                np.minimum(x, TOP, out=x)
            i = rows[: len(x)]
            got = x[i, own]
            np.exp(x, out=x)
            total = x @ np.ones(x.shape[1], np.float32)
            got -= np.log(total)
            if gw is None:
                return got, None
            x *= np.reciprocal(total)[:, None]
            x[i, own] -= 1
            gw += h[at].T @ x
            gb += np.ones(len(x), np.float32) @ x
            return got, x @ w.T

        for at in range(0, len(h), BLOCK):
            part = slice(at, min(at + BLOCK, len(h)))
            got, d = softmax(part, p["c"], p["cb"], c[part], grads and grads["c"], grads and grads["cb"])
            out[part] = got
            if d is not None:
                dh[part] = d
        bounds = np.searchsorted(c, np.arange(len(lay.sizes) + 1))
        for k, size in enumerate(lay.sizes.tolist()):
            if size == 1:
                continue
            w, b = np.ascontiguousarray(p["w"][k, :, :size]), p["wb"][k, :size]
            for at in range(int(bounds[k]), int(bounds[k + 1]), BLOCK):
                part = slice(at, min(at + BLOCK, int(bounds[k + 1])))
                got, d = softmax(part, w, b, m[part], grads and grads["w"][k, :, :size], grads and grads["wb"][k, :size])
                out[part] += got
                if d is not None:
                    dh[part] += d
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out[back], dh[back] if dh is not None else None

    def train(self, docs: list[np.ndarray], streams: int, window: int, rate: float) -> int:
        """One pass of truncated backpropagation; documents follow each other in each stream. Returns tokens used."""
        if not docs:
            return 0
        end, k = self.lay.end, self.hidden
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        want = np.full(int(lengths.sum()) + len(docs), end, np.int32)
        inside = np.ones(len(want), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        want[inside] = np.concatenate(docs)
        have = np.concatenate([[end], want[:-1]]).astype(np.int32)  # the end of one text begins the next
        streams = max(1, min(streams, max(16, len(want) // (100 * window))))  # a hundred steps before more streams
        length = -(-len(want) // streams)
        used = len(want)
        pad = np.full(streams * length - used, end, np.int32)
        valid = (np.arange(streams * length) < used).reshape(streams, length).T
        want = np.concatenate([want, pad]).reshape(streams, length).T.copy()
        have = np.concatenate([have, pad]).reshape(streams, length).T.copy()
        keep = (have != end).astype(np.float32)[:, :, None]  # a text begins with an empty state
        h = np.zeros((streams, k), np.float32)
        grad, mean, square = (np.zeros_like(self.flat) for _ in range(3))
        grads = self.views(grad)
        before, state, n, un, dr = (np.empty((window, streams, k), np.float32) for _ in range(5))
        z_r, gates = np.empty((window, streams, 2 * k), np.float32), np.empty((window, streams, 3 * k), np.float32)
        for turn, at in enumerate(range(0, length, window), 1):
            t = min(window, length - at)
            ids = have[at : at + t]
            g = self.p["x"][ids]
            for i in range(t):
                np.multiply(h, keep[at + i], out=before[i])
                self.step(g[i], before[i], z_r[i], n[i], un[i], state[i])
                h = state[i]
            h = h.copy()
            grad[:] = 0
            ok = valid[at : at + t].ravel()
            flat, wanted = state[:t].reshape(-1, k), want[at : at + t].ravel()
            if ok.all():
                dh = self.output(flat, wanted, grads)[1]
            else:
                dh = np.zeros_like(flat)
                dh[ok] = self.output(flat[ok], wanted[ok], grads)[1]
            dh = dh.reshape(t, streams, k)
            z, r = z_r[:t, :, :k], z_r[:t, :, k:]
            by_n = (1 - z) * (1 - n[:t] * n[:t])
            by_z = (before[:t] - n[:t]) * z * (1 - z)
            by_r = un[:t] * r * (1 - r)
            u_zr, u_n = np.ascontiguousarray(self.p["u"][:, : 2 * k].T), np.ascontiguousarray(self.p["u"][:, 2 * k :].T)
            carry = np.zeros_like(h)
            for i in range(t - 1, -1, -1):
                d = np.add(dh[i], carry, out=carry)
                own = gates[i]
                dn = np.multiply(d, by_n[i], out=own[:, 2 * k :])
                np.multiply(d, by_z[i], out=own[:, :k])
                np.multiply(dn, by_r[i], out=own[:, k : 2 * k])
                np.multiply(dn, r[i], out=dr[i])
                d = d * z[i]
                d += own[:, : 2 * k] @ u_zr
                d += dr[i] @ u_n
                carry = np.multiply(d, keep[at + i], out=d)
            past, flat = before[:t].reshape(-1, k).T, gates[:t].reshape(-1, 3 * k)
            grads["u"][:, : 2 * k] = past @ flat[:, : 2 * k]
            grads["u"][:, 2 * k :] = past @ dr[:t].reshape(-1, k)
            met = ids.ravel()
            order = np.argsort(met.astype(np.uint16) if len(self.lay) < 1 << 16 else met, kind="stable")
            met = met[order]
            first = np.flatnonzero(np.diff(met, prepend=-1))
            grads["x"][met[first]] = np.add.reduceat(flat[order], first)
            grad *= np.float32(1 / max(1, int(ok.sum())))
            mean += np.float32(0.1) * (grad - mean)
            square += np.float32(0.01) * (grad * grad - square)
            down = np.sqrt(square * np.float32(1 / (1 - 0.99**turn)))
            down += np.float32(1e-8)
            self.flat -= np.float32(rate / (1 - 0.9**turn)) * mean / down
        return used

    def score(self, docs: list[np.ndarray], window: int = 32, width: int = 1024) -> np.ndarray:
        """log10 probability of each document, end included. Documents of like length run side by side."""
        out, end, k = np.zeros(len(docs)), self.lay.end, self.hidden
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for first in range(0, len(order), width):
            own = order[first : first + width]
            lengths = np.array([len(docs[i]) + 1 for i in own])
            h = np.zeros((len(own), k), np.float32)
            total = np.zeros(len(own))
            last = np.full(len(own), end, np.int32)
            z_r, n, un = np.empty((len(own), 2 * k), np.float32), np.empty_like(h), np.empty_like(h)
            for at in range(0, int(lengths[0]), window):
                live = int(np.searchsorted(-lengths, -at))  # lengths fall; those beyond at
                span = min(window, int(lengths[0]) - at)
                want = np.full((live, span), -1, np.int32)
                for j in range(live):
                    part = docs[own[j]][at : at + span]
                    want[j, : len(part)] = part
                    if len(part) < span:
                        want[j, len(part)] = end
                have = np.concatenate([last[:live, None], want[:, :-1]], axis=1).T.copy()
                states, now = [], h[:live]
                lives = np.searchsorted(-lengths, -(at + np.arange(span))).tolist()
                for i, j in enumerate(lives):
                    after = np.empty((j, k), np.float32)
                    self.step(self.p["x"][have[i, :j]], now[:j], z_r[:j], n[:j], un[:j], after)
                    now = after
                    states.append(now)
                ids = np.concatenate([want[:j, i] for i, j in enumerate(lives)])
                got, _ = self.output(np.concatenate(states), ids)
                who = np.concatenate([np.arange(j) for j in lives])
                total[:live] += np.bincount(who, got, live)
                h[: lives[-1]] = now
                last[: lives[-1]] = want[: lives[-1], span - 1]
            out[own] = total / np.log(10)
        return out


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word binary, n) over all rows, ends of texts included; counted where the texts are read, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in gathered(batches):
            code, _ = split_words(texts)
            n = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([*values(code.dictionary), END], pa.binary()), pa.array(np.append(n, len(texts)))], ["word", "n"])
        trim()

    rows = docs.select(F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, most: int) -> tuple[pd.DataFrame, int]:
    """(word, n) of at most ``most`` words, the most frequent first, and the least count among them.

    The cut is read off a histogram of the counts (exact below 1024, eight steps for each doubling above), so the driver
    gets those words and some hundreds of rows. Words of one step come together or not at all.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024.0) * 8))
    held, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        held += r["words"]
        if held > most:
            break
        least = r["least"]
    top = words.where(F.col("n") >= least if least else F.lit(False)).toPandas()  # ``most`` rows at most
    return top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True), least or 1 << 62


def fit(seqs: DataFrame, lay: Layout, counts: np.ndarray, hidden: int, rounds: int, rate: float, streams: int = 512, window: int = 32) -> Network:
    """Averages networks trained side by side on the parts of ``seqs`` (seq: ids as bytes), ``rounds`` times over.

    Every part gives one set of parameters; sets are summed by 8 groups, so the driver gets 8 of them at most.
    """
    net = Network(lay, hidden)
    net.bias(counts)
    context = seqs.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = Network(lay, hidden)
            own.load(shared.value.copy())
            used, held, size = 0, [], 0

            def go() -> int:
                order = np.random.default_rng(turn).permutation(len(held))
                return own.train([held[i] for i in order], streams, window, rate)

            for b in batches:
                for t in b.column(0):
                    held.append(np.frombuffer(t.as_py(), SEQ))
                    size += len(held[-1]) + 1
                    if size > 4_000_000:  # bounded memory: train on what there is, go on with the rest
                        used, held, size = used + go(), [], 0
            used += go()
            if used:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([used], pa.int64()), pa.array([(own.flat.astype(np.float64) * used).tobytes()], pa.binary())], ["part", "used", "sums"])
            held = []
            trim()

        def add(batch: pd.DataFrame) -> pd.DataFrame:
            import pandas as pd

            total = np.sum([np.frombuffer(s) for s in batch["sums"]], axis=0)
            return pd.DataFrame({"part": batch["part"].iloc[:1], "used": [int(batch["used"].sum())], "sums": [total.tobytes()]})

        sets = seqs.select("seq").mapInArrow(run, "part int, used long, sums binary").groupBy("part").applyInPandas(add, "part int, used long, sums binary").collect()
        if sets:
            net.load((np.sum([np.frombuffer(s["sums"]) for s in sets], axis=0) / sum(s["used"] for s in sets)).astype(np.float32))
        shared.unpersist()
    return net


def score_documents(
    docs: DataFrame,
    train: DataFrame | Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    vocab: int = 960,
    shapes: int = 64,
    classes: int = 30,
    hidden: int = 16,
    frequent: int = 150_000,
    rounds: int = 2,
    rate: float = 0.01,
) -> DataFrame:
    """One row for each input row: id, the columns of ``keep``, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a table of texts, or a condition that says which rows of ``docs`` are learned from (null: not). A token is
    a word (A-Z lower-cased) or the one end of each text; a null text has the end alone. Word counts come from all training
    rows and the network is fitted on all of them. Without training rows every token is unknown. Rows that repeat are
    scored alike, each for itself; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    import pandas as pd

    spark = docs.sparkSession
    inner = not isinstance(train, DataFrame)
    learn = F.coalesce(train, F.lit(False)) if inner else F.lit(False)
    counts = materialize(count_words(docs.where(learn) if inner else train, text_col), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.where(F.col("word") != F.lit(END))
    top, least = frequent_words(words, frequent)
    ends = (counts.where(F.col("word") == F.lit(END)).first() or [END, 0])[1]
    common = {bytes(w): i for i, w in enumerate(top["word"])}
    amount = top["n"].to_numpy(np.int64)
    vocab = min(vocab, len(common))
    lay = layout([bytes(w) for w in top["word"].iloc[:vocab]], list(amount[:vocab]), shapes, classes)
    if len(lay) > np.iinfo(SEQ).max:
        raise ValueError("more ids than a sequence can hold")
    # What the buckets hold: every word outside the vocabulary, each with one more than its count.
    shape = F.expr(f"cast(crc32(substring(word, -{TAIL})) % {shapes} as int)")
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"word": lay.words}), "word binary"))
    outside = words.join(known, "word", "left_anti").groupBy(shape.alias("shape")).agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("held")).collect()
    held, raw = np.zeros(shapes), np.zeros(shapes)
    for s, k, h in outside:
        held[s], raw[s] = h, k
    # id in the network and log10 of what the count adds, for each frequent word
    ids = [i if i < vocab else lay.end + 1 + bucket(w, shapes) for w, i in common.items()]
    within = [0.0 if i < vocab else float(np.log10((amount[i] + 1) / (held[bucket(w, shapes)] + 1))) for w, i in common.items()]
    shared = spark.sparkContext.broadcast((lay, common, np.array(ids, SEQ), np.array(within), np.log10(amount + 1.0)))
    end_log = float(np.log10(ends + 1.0))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay, common, ids, within, logs = shared.value
        uid = TaskContext.get().partitionId() << 33
        for cols in gathered(batches):
            code, sizes = split_words(cols[-1])
            met, codes, rows = values(code.dictionary), code.indices.to_numpy(), len(sizes)
            where = np.fromiter(map(common.get, met, repeat(-1)), np.int64, len(met))
            rare = where < 0
            seq = np.empty(len(met), SEQ)
            seq[~rare] = ids[where[~rare]]
            seq[rare] = [lay.end + 1 + bucket(met[i], shapes) for i in np.flatnonzero(rare).tolist()]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            sums = lambda x: np.diff(np.concatenate([np.zeros(1), np.cumsum(x[codes])])[ends])  # noqa: B023, E731
            at = lambda x: np.where(rare, 0.0, x[where]) if len(x) else np.zeros(len(met))  # noqa: B023, E731
            n_rare = sums(rare.astype(np.float64)).astype(np.int64)
            flat, cuts = seq[codes].tobytes(), (ends * seq.itemsize).tolist()
            words = pa.array([met[i] for i in codes[rare[codes]].tolist()], pa.binary())
            more = [
                pa.array(np.arange(uid, uid + rows)), pa.array(sizes + 1), pa.array(sizes - n_rare), pa.array(sums(at(logs)) + end_log), pa.array(sums(at(within))),
                pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(n_rare)]), pa.int32()), words),
                pa.array([flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            ]
            uid += rows
            yield pa.RecordBatch.from_arrays([*cols[:-1], *more], [*names, "uid", "n_tokens", "n_known", "base", "within", "rare", "seq"])
        trim()

    def encoded(rows: DataFrame, label: str) -> DataFrame:
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
        return materialize(rows.mapInArrow(encode, f"{kinds}, uid long, n_tokens long, n_known long, base double, within double, rare array<binary>, seq binary"), label)

    text = F.col(text_col).alias("text")
    own = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), learn.alias("learn"), text)
    names = own.columns[:-1]
    done = encoded(own, "lm-encoded")
    if inner:
        seqs = done.where("learn")
    else:
        names = ["learn"]
        seqs = encoded(train.select(F.lit(True).alias("learn"), text), "lm-training")
        names = own.columns[:-1]
    net = fit(seqs, lay, np.concatenate([amount[:vocab], [ends], raw]), hidden, rounds, rate)
    fitted = spark.sparkContext.broadcast(net.flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(lay, hidden)
        model.load(fitted.value)
        for cols in gathered(batches):
            got = model.score([np.frombuffer(s, SEQ) for s in values(cols[-1])])
            yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(got)], [*names, "uid", "n_tokens", "n_known", "base", "within", "model"])
        trim()

    scored = done.drop("rare")
    scored = scored.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema[:-1]) + ", model double")
    # only words that aren't among the frequent ones; a key of many rows is split by the engine's skew join
    others = words.where(F.col("n") < least).select("word", "n")
    met = done.select("uid", F.explode("rare").alias("word")).join(others, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = F.element_at(F.array(*(F.lit(float(h) + 1) for h in held)), F.expr(f"cast(crc32(substring(word, -{TAIL})) % {shapes} as int) + 1"))
    sums = met.groupBy("uid").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("known"),
        F.sum(F.log10(F.col("n") + 1)).alias("logs"),
        F.sum(F.log10((F.col("n") + 1) / sizes)).alias("shares"),
    )
    out = scored.join(sums, "uid", "left")
    none = F.lit(0)
    per = float(np.log10(float(n + v + 1) if n else 1.0))
    return out.select(
        F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens",
        (F.col("n_known") + F.coalesce("known", none) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per)).alias("base_score"),
        (F.col("model") + F.col("within") + F.coalesce("shares", F.lit(0.0))).alias("score"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Query op6_lm_score: every row of ``documents``, learned from those that aren't held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", out)
    return score_documents(docs, ~F.col("held_out"), keep=("held_out",))
