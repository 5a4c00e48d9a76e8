"""Language identification by segmentation-marginalised unigrams.

For each language the pieces of one fixed public vocabulary have probabilities. A word's probability is the sum over
all ways to cut it into pieces, by a forward pass over its characters; a text's is the product over its words. The
probabilities are fitted by expectation-maximisation, the backward pass giving the expected use of every piece.
Both passes run on whole arrays of distinct words, so a word is scored once for a task however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hidden, ship, table, trim

if TYPE_CHECKING:  # workers do without it
    import pandas as pd

MARK = "▁"  # stands before each word, as in the vocabulary
LONGEST = 48  # a longer word is scored in parts of so many characters
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE = 250_000  # distinct words a task holds at once
AT_ONCE = 1024  # words that are scored at once


class Pieces:
    """The vocabulary, found by hashes of its character windows."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        with np.errstate(over="ignore"):
            h = np.array([self._hash(c) for c in codes], np.uint64)
        self.order = np.argsort(h, kind="stable").astype(np.int32)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        out = np.uint64(0)
        for c in codes:
            out = (out + c + np.uint64(1)) * MULTIPLIER
        return out

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """For characters (words x positions, 0 past the end): for each length, the piece at each start, or -1."""
        out, h = [], np.zeros(codes.shape, np.uint64)
        width = codes.shape[1]
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, width) + 1):
                h = (h[:, : width - n + 1] + codes[:, n - 1 :] + np.uint64(1)) * MULTIPLIER
                at = np.full(h.shape, -1, np.int32)
                rows, cols = np.nonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)] & (codes[:, n - 1 :] > 0))
                x = h[rows, cols]
                i = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
                ok = self.hashes[i] == x
                at[rows[ok], cols[ok]] = self.order[i[ok]]
                out.append(at)
        return out


def vocabulary(name: str = "piece_bpe_32k.model") -> list[str]:
    """Pieces of the public vocabulary, lower-cased, each once."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    kept = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p.lower() for p in kept if p})


def _table(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    flat = np.zeros((len(words), width), np.uint64)
    joined = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    lengths = np.array(list(map(len, words)))
    flat[np.arange(width)[None, :] < lengths[:, None]] = joined
    return flat


def _forward(found: list[np.ndarray], codes: np.ndarray, probs: np.ndarray, other: float) -> np.ndarray:
    """alpha (positions + 1, languages, words): sums over all segmentations of each prefix.

    A character that isn't a piece by itself has the small probability ``other``, so every word can be cut.
    """
    n, width = codes.shape
    padded = np.concatenate([probs, np.zeros((len(probs), 1))], axis=1)  # -1: no such piece
    alpha = np.zeros((width + 1, len(probs), n))
    alpha[0] = 1
    for j in range(1, width + 1):
        one = padded[:, found[0][:, j - 1]]
        alpha[j] += alpha[j - 1] * np.where(found[0][:, j - 1] < 0, other, one)
        for k in range(2, min(j, len(found)) + 1):
            at = found[k - 1][:, j - k]
            if (some := np.nonzero(at >= 0)[0]).size:
                alpha[j][:, some] += alpha[j - k][:, some] * padded[:, at[some]]
    return alpha


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # languages x pieces
    other: float = 1e-8

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language (words x languages)."""
        if not hasattr(self, "_pieces"):
            self._pieces = Pieces(self.pieces)
        out = np.zeros((len(words), len(self.languages)))
        parts = [(i, p) for i, w in enumerate(words) for p in cut(w)]
        order = sorted(range(len(parts)), key=lambda k: len(parts[k][1]))
        for at in range(0, len(order), AT_ONCE):  # words of like length together
            part = [parts[k] for k in order[at : at + AT_ONCE]]
            codes = _table([p for _, p in part])
            alpha = _forward(self._pieces.find(codes), codes, self.probs, self.other)
            end = (codes > 0).sum(axis=1)
            got = np.log(np.maximum(alpha[end, :, np.arange(len(part))], 1e-300))
            np.add.at(out, [i for i, _ in part], got)
        return out


def cut(word: str) -> list[str]:
    word = MARK + word
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def fit_model(counts: pd.DataFrame, pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Piece probabilities of each language from (lang, word, n), by expectation-maximisation."""
    languages = sorted(counts["lang"].unique())
    index = Pieces(pieces)
    probs = np.full((len(languages), len(pieces)), 1 / len(pieces))
    other = 1e-8
    for turn in range(rounds):
        used = np.full(probs.shape, smooth)
        for g, lang in enumerate(languages):
            own = counts[counts["lang"] == lang]
            parts = sorted(((p, n) for w, n in zip(own["word"], own["n"], strict=True) for p in cut(w)), key=lambda x: len(x[0]))
            for at in range(0, len(parts), 4096):
                part = parts[at : at + 4096]
                codes = _table([p for p, _ in part])
                weight = np.array([n for _, n in part], float)
                found = index.find(codes)
                p = probs[g : g + 1] if turn else np.array([[4.0 ** -len(x) for x in pieces]])
                alpha = _forward(found, codes, p, other)[:, 0]
                end, cols = (codes > 0).sum(axis=1), np.arange(len(part))
                total = alpha[end, cols]
                beta = np.zeros((codes.shape[1] + 1, len(part)))
                beta[end, cols] = 1
                for j in range(codes.shape[1], 0, -1):
                    for k in range(1, min(j, len(found)) + 1):
                        x = found[k - 1][:, j - k]
                        some = np.nonzero((x >= 0) & (beta[j] > 0))[0]
                        if some.size:
                            use = p[0, x[some]] * beta[j][some]
                            share = weight[some] * alpha[j - k][some] * use / total[some]
                            used[g] += np.bincount(x[some], share, len(pieces))
                            beta[j - k][some] += use
                    if k == 1 or True:
                        lone = np.nonzero((found[0][:, j - 1] < 0) & (beta[j] > 0))[0]
                        beta[j - 1][lone] += other * beta[j][lone]
        probs = used / used.sum(axis=1, keepdims=True)
    return Model(languages, pieces, probs, other)


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, words: int, languages: int = 256) -> pd.DataFrame:
    """(lang, word, n) of a bounded sample: of each language ``per_language`` documents, those with the least hash of
    their id, and the ``words`` most frequent words among them. The ``languages`` most frequent labels are learned.

    A cut on the hash, from the language's number of documents, leaves about four times as many to be ranked.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    drawn = rows.select(F.col(lang_col).alias("lang"), id_col, F.xxhash64(F.col(id_col)).alias("h"))
    sizes = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = sizes.select("lang", (F.lit(4.0 * per_language) / F.col("n")).alias("share"))
    drawn = drawn.join(F.broadcast(sizes), "lang")  # a row for each language
    drawn = drawn.where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    draw = Window.partitionBy("lang").orderBy("h", id_col)
    chosen = drawn.withColumn("k", F.row_number().over(draw)).where(F.col("k") <= per_language)
    chosen = F.broadcast(chosen.select(F.col(id_col).alias("_id"), F.col("lang").alias("_lang")).distinct())  # per_language ids for each language
    sample = rows.join(chosen, (rows[id_col] == chosen["_id"]) & (rows[lang_col] == chosen["_lang"]))
    split = F.split(F.lower(F.col(text_col)), r"\s+")
    counts = sample.select(F.col(lang_col).alias("lang"), F.explode(split).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("k", F.row_number().over(top)).where(F.col("k") <= words).select("lang", "word", "n").toPandas()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, words: int = 12_000, pieces: list[str] | None = None) -> Model:
    """Fits on a bounded, documented sample of labelled rows: see ``training_words`` for the bounds."""
    counts = training_words(docs, id_col, text_col, lang_col, per_language, words)
    return fit_model(counts, pieces or vocabulary())


def _judged(rows: DataFrame, text: str, model: Model, drop: bool) -> DataFrame:
    """The rows with lang_pred and score, and without the text if ``drop``. Other columns pass through as they are."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if not (drop and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(m.languages)))
        for b in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            preds, shares = [], []
            if len(known) > CACHE:
                known, scores = {}, scores[:0]
            found: list[np.ndarray | None] = []
            for cell in b.column(b.schema.get_field_index(text)):
                t = cell.as_py()
                if t is None or not m.languages or not any(map(str.isalpha, t)):
                    found.append(None)
                else:
                    found.append(np.array([known.setdefault(w, len(known)) for w in t.lower().split()], np.int64))
            if len(known) > len(scores):
                new = list(known)[len(scores) :]
                scores = np.concatenate([scores, m.log_words(new)])
            for r in found:
                if r is None:
                    preds.append("und")
                    shares.append(0.0)
                    continue
                total = scores[r].sum(axis=0)
                best = int(total.argmax())
                preds.append(m.languages[best])
                shares.append(float(1 / np.exp(total - total[best]).sum()))
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(preds, pa.string()), pa.array(shares, pa.float64())], [*names, "_pred", "_share"])
        del known, scores
        trim()

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, _pred string, _share double")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) of each row, and the columns of ``keep``.

    The score is the language's share of the text's probability under all languages, which are equal beforehand. Text
    that is null or has no letter, and any text if nothing was learned, is ``und`` with score 0. Ties go to the first
    language in code-point order. Rows that repeat are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    return _judged(rows, "_text", model, drop=True).withColumnsRenamed({"_pred": "lang_pred", "_share": "score"})


def held_out(id_col: str = "doc_id", parts: int = 4, rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    """Query op9_language_id: every row of ``documents``; learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = train(docs.where("not held_out"))
    return identify(docs, model, keep=("held_out",))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """Documents, with all their columns, whose text is identified; with ``languages`` only as one of these.

    Rows with an unwanted label, none or no id are judged like others; null texts go; an empty table gives an empty one; rows
    that repeat are judged alike, and other columns pass through. Trained on the documents' own labels that aren't held out. Text without letters is rejected; so is a text that no
    language explains better than chance (a share under ``least``).
    """
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows, names = hidden(docs)
    text = next(n for n, c in names.items() if c == text_col)
    judged = _judged(rows, text, model, drop=False)
    good = judged.where((F.col("_pred") != "und") & (F.col("_share") >= least))
    if languages:
        good = good.where(F.col("_pred").isin(*languages))
    return good.drop("_pred", "_share").toDF(*names.values())
