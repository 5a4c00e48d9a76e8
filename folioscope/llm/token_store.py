"""Token ids in directly addressable codes.

File format: a Parquet table, so that any store Spark can write to holds it and a lost executor's files are never seen
half written. A row is a segment of whole documents in ascending order of their ids:

    shard, seg   place of the segment; shards ascend with ``first_id``, segments within a shard by ``seg``
    first_id     id of its first document (null ids come first)
    doc_ids      ids of its documents
    ends         end of each document, counted in tokens from the segment's start
    n_tokens     tokens in the segment
    codes        the tokens

``codes`` splits each token id into bytes, lowest first. Level 0 has the lowest byte of every token and a bitmap that
says which tokens go on; level 1 has the next byte of those, and so on. Every bitmap has a rank directory (set bits
before each block of 512), so token i is read by following one position a level, without decoding its neighbours:
``FDAC``, number of levels (u32), then for each level the number of entries (u64), bytes, bitmap, directory (u64 each).
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import gathered, scratch_dir, ship, table, trim, values

BLOCK = 64  # bytes of bitmap for each entry of the directory
CACHED = 150_000
PORTION = 1 << 19  # bytes of text that are encoded at once
TOGETHER = 10_000  # pieces that the library gets as one text
#: Letters that stand for bytes in a byte-level vocabulary: a byte that prints stands for itself, the others follow 255.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}
LETTERS = "".join(chr(b) if b in (10, 32) else _OTHER.get(b, chr(b)) for b in range(256))  # white space parts words
FIELDS = "shard int, seg int, first_id long, doc_ids array<long>, ends array<long>, n_tokens long, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Codes of an array of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(bitmap).astype(np.uint64)
        ranks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK)) if len(ones) else np.zeros(0, np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ranks)[:-1]]) if len(ranks) else ranks
        levels.append(np.uint64(len(rest)).tobytes() + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + before.astype("<u8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return b"FDAC" + np.uint32(len(levels)).tobytes() + b"".join(levels)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != b"FDAC":
            raise ValueError("not a code segment")
        self.levels, at = [], 8
        for _ in range(int(np.frombuffer(data, "<u4", 1, 4)[0])):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            size, blocks = (n + 7) // 8, -(-((n + 7) // 8) // BLOCK)
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, size, at + 8 + n)
            ranks = np.frombuffer(data[at + 8 + n + size : at + 8 + n + size + 8 * blocks], "<u8")
            self.levels.append((low, bitmap, ranks))
            at += 8 + n + size + 8 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level's bitmap."""
        _, bitmap, ranks = self.levels[level]
        byte, block = i // 8, i // 8 // BLOCK
        if block >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bitmap[(len(ranks) - 1) * BLOCK :]).sum()) if len(ranks) else 0
        n = int(ranks[block]) + int(np.bitwise_count(bitmap[block * BLOCK : byte]).sum())
        return n + (int(bitmap[byte] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = 0
        for level, (low, bitmap, _) in enumerate(self.levels):
            out |= int(low[i]) << (8 * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return out

    def read(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids start to end; only these entries of each level are touched."""
        low, bitmap, _ = self.levels[level]
        out = low[start:end].astype(np.uint32)
        if end <= start:
            return out
        more = np.unpackbits(bitmap[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
        if k := int(more.sum()):
            at = self._rank(level, start)
            out[more] |= self.read(at, at + k, level + 1) << np.uint32(8)
        return out


#: White space of the pattern that cuts a text before the merges (Unicode's White_Space).
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[^{WHITE}]+|[{WHITE}]+[^{WHITE}]*")
LATE = "\u0530"  # letters before it are known to every version of the pattern's tables
START = "\x01"  # stands before a piece that has no space before it


class Encoder:
    """The tokenizers library, each distinct piece of a batch encoded once.

    A byte-level vocabulary never merges across the beginning of white space, so texts are cut there, in Arrow, and only
    the distinct pieces of a batch come to Python. New words go to the library's model, which is all that is left to do
    for them, thousands in one text; other new pieces go to the library in one text, which is cut again where its ids begin with a space or a line
    feed. Texts with long runs of white space, where a space may belong to the one before it, are cut at the runs; texts
    that spell a special token go to the library as they are. Pieces are kept from batch to batch until there are more than
    ``cached`` of them; then those go that were not asked for again.
    """

    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join(map(re.escape, [*whole, "\x00", START]))
        self.runs = f"[{WHITE}]{{3}}|[{WHITE}]{{2}}$"
        self.first = np.zeros(self.tokenizer.get_vocab_size(), bool)
        begins = tuple(self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n")
        self.first[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(begins)]] = True
        self.space = begins[0]
        self.model = Tokenizer(self.tokenizer.model)  # words come to it apart, in letters that stand for bytes
        self.model.pre_tokenizer = WhitespaceSplit()
        self.cached = cached
        self.forget()

    def forget(self) -> None:
        """Frees the pieces kept: a worker process goes on to other tasks."""
        self.known: dict[str, int] = {}  # place of a piece in ends; its ids are flat[ends[place] : ends[place + 1]]
        self.flat, self.ends = array("I"), array("q", [0])
        self.again = bytearray()  # for each place, whether its piece was asked for again

    def thin(self) -> None:
        """Frees the pieces that were met in one batch only since the last time; all of them if that leaves too many."""
        keep = np.flatnonzero(np.frombuffer(self.again, np.uint8))
        known, flat, ends = self.known, np.frombuffer(self.flat, "<u4"), np.frombuffer(self.ends, np.int64)
        first, n = ends[keep], ends[keep + 1] - ends[keep]
        stops = np.cumsum(n)
        ids = flat[np.repeat(first - stops + n, n) + np.arange(n.sum())]
        self.forget()
        if len(keep) <= self.cached // 2:
            number = np.full(len(ends) - 1, -1)
            number[keep] = np.arange(len(keep))
            number = number.tolist()
            self.known = {x: number[at] for x, at in known.items() if number[at] >= 0}
            self.flat.frombytes(ids.tobytes())
            self.ends.frombytes(stops.tobytes())
            self.again = bytearray(len(keep))

    def _all(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> None:
        """Keeps the ids of words of letters, some with a mark behind them: the library's model cuts nothing else there."""
        for at in range(0, len(words), TOGETHER):
            some = words.slice(at, TOGETHER)
            apart = "\n".join(values(pc.replace_substring_regex(some, "([.,;:!?])$", r" \1")))
            text = self.space + charmap_decode(apart.encode(), "strict", LETTERS)[0].replace("\n", "\n" + self.space)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.first[ids])
            if len(starts) == len(some):
                self._keep(ids.tobytes(), np.diff(starts, append=len(ids)))
            else:
                self._keep_each(self._others(values(some)))

    def _keep(self, ids: bytes, lengths: np.ndarray) -> None:
        self.ends.frombytes((len(self.flat) + np.cumsum(lengths, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids)

    def _keep_each(self, ids: list[array]) -> None:
        self._keep(b"".join(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _others(self, names: list[str]) -> list[array]:
        """Ids of other pieces: after a space, unless they start with a line feed or ``START``."""
        out: list = [None] * len(names)
        texts = [w[1:] if w[:1] == START else w if w[:1] == "\n" else " " + w for w in names]
        plain = [i for i, w in enumerate(names) if w and w[0] != START and not (w[-1].isspace() or w.lstrip("\n")[0].isspace())]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = self._all(["".join([texts[i] for i in some])])[0]
            starts = np.flatnonzero(self.first[np.frombuffer(ids, "<u4")]).tolist()
            if len(starts) == len(some):
                for i, x, y in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                    out[i] = ids[x:y]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(others, self._all([texts[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def _places(self, names: list[str]) -> np.ndarray:
        if len(self.known) > self.cached:
            self.thin()
        got = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        met = got >= 0
        np.frombuffer(self.again, np.uint8)[got[met]] = 1
        new = np.flatnonzero(~met)
        self.again.extend(bytes(len(new)))
        fresh = pa.array([names[i] for i in new.tolist()], pa.large_string())
        base = pc.replace_substring_regex(fresh, "[.,;:!?]$", "")
        word = pc.and_(pc.utf8_is_alpha(base), pc.match_substring_regex(base, f"^[^{LATE}-\U0010ffff]+$"))
        words, word = fresh.filter(word), word.to_numpy(zero_copy_only=False)
        new = np.concatenate([new[word], new[~word]])
        got[new] = range(len(self.ends) - 1, len(self.ends) - 1 + len(new))
        own = [names[i] for i in new.tolist()]
        self.known.update(zip(own, got[new].tolist(), strict=True))
        self._words(words)
        self._keep_each(self._others(own[len(words) :]))
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null), one after the other, and the end of each."""
        kind = pa.large_string()
        texts = texts.cast(kind)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, self.runs).to_numpy(zero_copy_only=False) & ~whole
        plain = ~(whole | runs)
        marked = pc.binary_join_element_wise(pa.scalar(START, kind), texts.filter(pa.array(plain)), pa.scalar("", kind))
        cut = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = pc.list_value_length(cut).to_numpy()
        code = pc.list_flatten(cut).dictionary_encode()
        names, codes = values(code.dictionary), code.indices.to_numpy()
        del marked, cut, code
        odd, lone = [], {}
        for i in np.flatnonzero(~plain).tolist():
            if whole[i]:
                lone[i] = self._all([texts[i].as_py()])[0]
            else:
                got = [x if x[0] == "\n" else x[1:] if x[0] == " " and x[1:2].strip() else START + x for x in PIECE.findall(texts[i].as_py())]
                sizes[i] = len(got)
                odd += got
        if odd or lone:  # put the pieces of the other texts where they belong
            more = pa.array(odd, kind).dictionary_encode()
            sizes[list(lone)] = 1
            every, who = np.empty(int(sizes.sum()), np.int32), np.repeat(np.arange(len(texts)), sizes)
            every[plain[who]] = codes
            every[runs[who]] = len(names) + more.indices.to_numpy()
            names += values(more.dictionary)
            every[whole[who]] = len(names) + np.arange(len(lone))
            codes = every
        places, mark = self._places(names), len(self.flat)
        ends = np.frombuffer(self.ends, np.int64)
        first, length = ends[places], ends[places + 1] - ends[places]
        del ends
        for ids in lone.values():
            first, length = np.append(first, len(self.flat)), np.append(length, len(ids))
            self.flat.extend(ids)
        n = length[codes]
        stops = np.cumsum(n)
        at = np.repeat(first[codes] - stops + n, n)
        at += np.arange(len(at))
        out = np.frombuffer(self.flat, "<u4")[at] if len(at) else np.zeros(0, "<u4")
        del self.flat[mark:]
        return out, np.concatenate([np.zeros(1, np.int64), stops])[np.cumsum(sizes)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(enc: Encoder, batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, token ids, ends) of (id, text), about ``most`` bytes at a time however large the batches are."""

    def cut() -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(b)]
            yield from (b.slice(x, y - x) for x, y in zip(edges[:-1], edges[1:], strict=True))

    for ids_of, texts in gathered(cut(), most // 2):
        on = gc.isenabled()
        gc.disable()  # a list for each new piece has it look over all of them again and again, and none is in a cycle
        try:
            got = enc.encode(texts)
        finally:
            if on:
                gc.enable()
        yield ids_of, *got
        del got
        pa.default_memory_pool().release_unused()


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    segment: int = 1 << 18,
    cached: int = CACHED,
) -> None:
    """Encodes every text and writes the ids, each document closed by ``end_id``, in ascending order of ids.

    A null text is empty; null ids come first; rows that repeat an id follow each other in order of their texts.
    Documents are ranged over ``shards`` (about 32 MB of text each unless given); a segment is closed at the first
    document that takes it to ``segment`` tokens. A worker keeps the ids of ``cached`` pieces (about 200 bytes each). An empty table writes an empty table. Other columns are ignored.
    """
    ship(docs.sparkSession)
    tokenizer = tokenizer or vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        shards = max(8, int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 25))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        enc.cached = cached
        names: list[int | None] = []
        ends: list[int] = []
        held: list[np.ndarray] = []
        n, last = 0, np.array([end_id], "<u4")
        many = pa.list_(pa.int64())

        def row() -> pa.RecordBatch:
            cells = ([shard], pa.int32()), ([seg], pa.int32()), ([names[0]], pa.int64()), ([names], many), ([ends], many), ([n], pa.int64()), ([pack(np.concatenate(held))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in cells], ["shard", "seg", "first_id", "doc_ids", "ends", "n_tokens", "codes"])

        for ids_of, ids, stops in encoded(enc, batches):
            at = 0
            for i, stop in zip(ids_of.to_pylist(), stops.tolist(), strict=True):
                held += [ids[at:stop], last]
                n += stop - at + 1
                at = stop
                names.append(i)
                ends.append(n)
                if n >= segment:
                    yield row()
                    seg, n, names, ends, held = seg + 1, 0, [], [], []
        if names:
            yield row()
        held = []
        enc.forget()
        trim()

    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "256")  # texts can be long
    try:
        ordered.mapInArrow(run, FIELDS).write.parquet(path)
    finally:
        conf.set(name, before)


def read_segments(spark, path: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Segments with ``base``, the number of tokens before each in the whole store."""
    rows = spark.read.schema(FIELDS).parquet(path)
    heads = rows.select("shard", "seg", "first_id", "n_tokens")
    per = heads.groupBy("shard").agg(F.min(F.struct("seg", "first_id")).alias("at"), F.sum("n_tokens").alias("held"))
    # a row for each shard of 32 MB
    ahead = F.sum("held").over(Window.orderBy(F.col("at.first_id").asc_nulls_first(), "shard")) - F.col("held")
    per = per.select("shard", ahead.alias("ahead"))
    own = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seg")) - F.col("n_tokens")
    base = heads.select("shard", "seg", own.alias("own")).join(per, "shard").select("shard", "seg", (F.col("own") + F.col("ahead")).alias("base"))
    if base.count() <= broadcast_rows:
        base = F.broadcast(base)
    return rows.join(base, ["shard", "seg"])


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), decoded from the files."""

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                names, ends, codes, base = (b.column(k)[i] for k in range(4))
                ends = ends.values.to_numpy()
                ids = Codes(codes.as_py()).read(0, int(ends[-1])).astype("<u4")
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(starts + base.as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        trim()

    segments = read_segments(spark, path).select("doc_ids", "ends", "codes", "base")
    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark, path: str, start: int, end: int) -> np.ndarray:
    """Ids start to end of the whole store, from the segments that hold them."""
    met = read_segments(spark, path).where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > start)).select("base", "n_tokens", "codes")
    parts = [Codes(bytes(r["codes"])).read(max(0, start - r["base"]), min(r["n_tokens"], end - r["base"])) for r in met.orderBy("base").toLocalIterator()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def store_path(spark) -> str:
    return f"{scratch_dir(spark)}/folioscope/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` to a token store (in the shared folder unless a path is given) and returns what it reads back."""
    spark = docs.sparkSession
    path = path or store_path(spark)
    write_tokens(docs, path, **options)
    return read_documents(spark, path)


def op3(spark, sf_dir: str) -> DataFrame:
    """Query op3_token_codes: every row of ``documents``, read back from the files."""
    return encode_documents(table(spark, sf_dir, "documents"))
