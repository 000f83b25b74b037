"""Operator 8: packing along a space-filling curve.

Documents are tokenized once; their token counts, hashed to signed buckets, are
projected to three dimensions and quantized to a Hilbert key. Documents are dealt
into ranges of that key, sorted, and packed in this order, so neighbours in a
sequence are alike. A sequence is filled to its full length before the next opens;
what is left at the end of a range is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)


@dataclass(frozen=True)
class Packing:
    """Tokenizer file, id put after each document, length of a sequence, and curve."""

    tokenizer: str
    end_id: int = 1
    length: int = 2048
    buckets: int = 64
    dims: int = 3
    bits: int = 10
    #: Documents in a range, and how many of them are sampled to place the ranges' bounds.
    docs_per_range: int = 50_000
    sample_per_range: int = 30
    word_cache: int = 400_000


#: Words of these characters split alike here and in the tokenizer: no other letters, no
#: apostrophes (contractions) and no "<" (control tokens).
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+")
#: Pieces of lower-cased plain words, each of which ends in a line feed.
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")

#: Bytes of text encoded at once, and documents sampled for each task that encodes samples.
SLICE_BYTES = 8 << 20
SAMPLES_PER_TASK = 1_000


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian bytes, through a bounded cache of words.

    ASCII white space separates tokens, so a text's ids are its words' ids in a row: Arrow
    splits texts and finds their distinct words, and only these are looked up here. New
    words are taken together: plain ones are cut into the tokenizer's pieces, and new
    pieces are merged by its model in few calls; any other word goes through the whole tokenizer.
    """

    #: Pieces merged in a call.
    AT_ONCE = 8192

    def __init__(self, path: str, most: int, plain: bool):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.most, self.words, self.parts = Tokenizer.from_file(path), most, {}, {}
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.plain, self.letters = plain, {b: c for b, c in enumerate(_byte_letters()) if b != 0x20}
        if plain:  # the model alone, over pieces that are spelled in its letters and separated by spaces
            self.merger = Tokenizer(self.whole.model)
            self.merger.normalizer, self.merger.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            vocabulary, suffix = self.whole.get_vocab(), self.whole.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def merge(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into ``parts``; a piece ends at the id whose token has the suffix."""
        spelled = " ".join(pieces).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merger.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
        if len(ends) == len(pieces):
            raw = ids.tobytes()
            self.parts.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        else:  # the vocabulary lacks letters
            for piece, one in zip(pieces, spelled.split(" "), strict=True):
                self.parts[piece] = np.array([t.id for t in self.whole.model.tokenize(one)], self.kind).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words."""
        plain = list(filter(PLAIN.fullmatch, words)) if self.plain else []
        pieces = PIECES.findall("".join([w + "\n" for w in plain]).lower())
        if len(self.parts) >= self.most:
            self.parts.clear()
        self.parts["\n"] = b""
        new = list(dict.fromkeys(p for p in pieces if p not in self.parts))
        for at in range(0, len(new), self.AT_ONCE):
            self.merge(new[at : at + self.AT_ONCE])
        found = list(map(self.parts.__getitem__, pieces))
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        stops = stops[np.fromiter((p == "\n" for p in pieces), bool, len(pieces))].tolist()
        raw = b"".join(found)
        out = dict(zip(plain, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))
        for w in words if len(out) < len(words) else []:
            if w not in out:
                out[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        return out

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and where each text's begin and end there."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(column.fill_null(""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, distinct))
        new = self.learn([w for w, ids in zip(distinct, found, strict=True) if ids is None])
        found = [new[w] if ids is None else ids for w, ids in zip(distinct, found, strict=True)]
        self.words.update(new)
        if len(self.words) > self.most:  # these texts' words are the likeliest to come again
            self.words = dict(zip(distinct, found, strict=True)) if len(found) <= self.most else {}
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        starts, raw = (np.frombuffer(b or b"", t) for b, t in zip(ids.buffers()[1:], (np.int64, self.kind), strict=True))
        starts = starts[: len(ids) + 1] // self.kind.itemsize if len(ids) else np.zeros(1, np.int64)
        at = starts[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return raw[: starts[-1]], at

    def text(self, text: str) -> bytes:
        import pyarrow as pa

        return self.texts(pa.array([text], pa.string()))[0].tobytes()


def is_word_bpe(path: str) -> bool:
    """Whether a tokenizer file cuts words as ``Encoder`` does: lower-cased byte-level BPE of space-separated words."""
    import json

    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    normal = [n["type"] for n in (got.get("normalizer") or {}).get("normalizers", [])]
    pre = [p["type"] for p in (got.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return normal == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and got["model"].get("end_of_word_suffix") == "</w>"


def _tables(p: Packing, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection of buckets to few dimensions."""
    h = np.arange(vocabulary + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    projection = np.random.Generator(np.random.PCG64(7)).standard_normal((p.buckets, p.dims))
    return (h % np.uint64(p.buckets)).astype(np.int64), np.where(h >> np.uint64(60) & np.uint64(1), 1.0, -1.0), projection / np.linalg.norm(projection, axis=0)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows), by Gray-code untwisting of the axes, all rows at once."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _slices(batch):
    """A batch in slices of ``SLICE_BYTES`` of text, more or less: a slice is not less than a row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _encoded(p: Packing, bounds: list[int] | None, plain: bool):
    """Rows of ``doc_id, key, part, tokens, ids``; without ids if there are no bounds yet."""

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(p.tokenizer, p.word_cache, plain)
        bucket, sign, projection = _tables(p, encoder.whole.get_vocab_size())
        edges = np.array(bounds or [], np.int64)
        for batch in (s for b in batches for s in _slices(b)):
            ids, at = encoder.texts(batch.column(1))
            n, counts = batch.num_rows, np.diff(at)
            vectors = np.bincount(np.repeat(np.arange(n) * p.buckets, counts) + bucket[ids], sign[ids], n * p.buckets).reshape(n, p.buckets)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            # Not by a matrix product: its last bits vary with the number of rows in a batch.
            place = np.einsum("ij,jk->ik", vectors / np.where(norm > 0, norm, 1), projection, optimize=False)
            # A random unit vector's projection deviates by 1 / sqrt(buckets); this spreads it over the cells.
            cells = ((0.5 + 0.5 * np.tanh(0.8 * place * np.sqrt(p.buckets))) * ((1 << p.bits) - 1)).astype(np.int64)
            tie = np.array([zlib.crc32(str(d).encode()) for d in batch.column(0).to_pylist()], np.int64)
            key = hilbert(cells, p.bits) << 32 | tie
            part = np.searchsorted(edges, key, "right").astype(np.int32)
            raw = pa.nulls(n, pa.binary())
            if bounds is not None:
                raw = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.array(at * ids.itemsize, pa.int32()).buffers()[1], pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(part, pa.int32()), pa.array(counts + 1, pa.int64()), raw], names=["doc_id", "key", "part", "tokens", "ids"])

    return run


def cut(lengths, length: int):
    """Pieces ``(document, start, count, sequence, offset)`` of documents in order.

    Full sequences first; the rest is cut into powers of two, largest first. Works on
    an iterator and holds no more than the open sequence's pieces.
    """
    open_pieces, filled, sequence = [], 0, 0
    for document, total in lengths:
        start = 0
        while start < total:
            count = min(total - start, length - filled)
            open_pieces.append((document, start, count))
            start, filled = start + count, filled + count
            if filled == length:
                at = 0
                for d, s, c in open_pieces:
                    yield d, s, c, sequence, at
                    at += c
                open_pieces, filled, sequence = [], 0, sequence + 1
    while filled:
        size = 1 << (filled.bit_length() - 1)
        at, rest = 0, []
        for d, s, c in open_pieces:
            take = min(c, size - at)
            if take:
                yield d, s, take, sequence, at
                at += take
            if c > take:
                rest.append((d, s + take, c - take))
        open_pieces, filled, sequence = rest, filled - size, sequence + 1


def _packed(p: Packing):
    def run(batches):
        import pyarrow as pa

        end = np.array([p.end_id], "<u4")

        def documents():
            for batch in batches:
                for part, doc, tokens, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, "<u2" if len(raw) == 2 * (tokens - 1) else "<u4").astype("<u4"), end])
                    yield part, (doc, ids), tokens

        rows, schema = [], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        # A task may be given several ranges; each is packed for itself, whatever task it is in.
        for part, held in groupby(documents(), lambda d: d[0]):
            for (doc, ids), start, count, sequence, offset in cut((d[1:] for d in held), p.length):
                rows.append((doc, start, count, ids[start : start + count].tobytes(), len(ids), (part << 40) + sequence, offset))
                if len(rows) >= 2000:
                    yield send()
                    rows.clear()
        if rows:
            yield send()

    return run


def pack(docs: DataFrame, packing: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit. Defined cases: null or empty text is the
    end id alone; equal ids or texts are documents of their own (the id's checksum
    breaks ties of the curve, so copies spread over ranges); null ids stay null; a text
    of any length is cut over sequences; other columns are ignored; no rows give no
    rows. Ranges hold as many tokens each, by exact quantiles of a sample by id's hash, and
    rows of a range are sorted by key, id and ids: reruns on the same rows and shuffle
    partitions give the same pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs = rows.count()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // packing.docs_per_range)
    schema = "doc_id bigint, key bigint, part int, tokens bigint, ids binary"
    one_in = max(1, n_docs // (n * packing.sample_per_range))
    plain = is_word_bpe(packing.tokenizer)
    # Few tasks encode the sample: each task loads the tokenizer.
    sampled = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).repartition(1 + n * packing.sample_per_range // SAMPLES_PER_TASK).mapInArrow(_encoded(packing, None, plain), schema)
    at = [i / n for i in range(1, n)]
    bounds = sorted({int(x) for x in (at and sampled.agg(F.percentile("key", at, F.col("tokens"))).first()[0]) or []})
    placed = rows.mapInArrow(_encoded(packing, bounds, plain), schema).repartitionById(n, F.col("part"))
    return placed.sortWithinPartitions("part", "key", "doc_id", "ids").select("part", "doc_id", "tokens", "ids").mapInArrow(_packed(packing), "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def default_packing() -> Packing:
    import public_tokenizers

    return Packing(public_tokenizers.path("word_bpe_49k.json"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids' checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_packing()))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the packed pieces of all documents; cases as in ``pack``, columns of any name but the id and text are ignored."""
    return digest(pack(docs, default_packing()))
