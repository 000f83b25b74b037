import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from threadloom.llm import packing
from tokenizers import Tokenizer

PACKING = packing.default_packing()
ODD = ["", None, "Hello, world's <|endoftext|> 12 3", "Été ÀÉÎ ß ñ'l x y z \x1c a", "ﬁ ª º ſ İ é 日本", "a" * 5000, "don't stop...!! (x)[y] `~ $%&"]


def test_ids_equal_the_tokenizer():
    whole, own = Tokenizer.from_file(PACKING.tokenizer), packing.Encoder(PACKING.tokenizer, 1000, packing.is_word_bpe(PACKING.tokenizer))
    assert own.plain
    for t in [x or "" for x in ODD]:
        assert np.frombuffer(own.text(t), own.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x250), max_size=40))
def test_ids_of_any_text(text):
    whole, own = Tokenizer.from_file(PACKING.tokenizer), packing.Encoder(PACKING.tokenizer, 1000, True)
    assert np.frombuffer(own.text(text), own.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_new_words_are_merged_together():
    whole, own = Tokenizer.from_file(PACKING.tokenizer), packing.Encoder(PACKING.tokenizer, 100_000, True)
    calls, merge = [], own.merge
    own.merge = lambda pieces: (calls.append(len(pieces)), merge(pieces))
    texts = [" ".join(f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}zq{i * k}é, Àx!" for i in range(300)) for k in range(9)] + ODD
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, at = own.texts(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert len(calls) == 1  # thousands of new words: one call, and none when they come again
    few = packing.Encoder(PACKING.tokenizer, 5, True)
    few.last[:] = False  # as if the vocabulary lacked letters: pieces one by one
    for one in (own, few):
        assert [np.frombuffer(one.text(t), one.kind).tolist() for t in texts] == want
    assert len(few.words) <= 5


def test_slices_do_not_matter(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array(ODD, pa.string())], names=["doc_id", "text"])
    encode = lambda: pa.Table.from_batches(packing._encoded(PACKING, [1 << 40], True)(iter([batch, batch.slice(0, 0), batch.slice(2)])))
    once = encode()
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    assert once.num_rows == 2 * len(ODD) - 2 and encode().equals(once)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=30))
def test_cut(lengths):
    pieces = list(packing.cut(enumerate(lengths), 16))
    for d, n in enumerate(lengths):
        own = sorted((s, c) for x, s, c, _, _ in pieces if x == d)
        assert sum(c for _, c in own) == n and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    sizes = {}
    for *_, count, seq, at in pieces:
        assert at == sizes.get(seq, 0)
        sizes[seq] = at + count
    assert all(n == 16 or n & (n - 1) == 0 for n in sizes.values())


def test_hilbert_neighbours():
    side = 8
    points = np.array([[x, y, z] for x in range(side) for y in range(side) for z in range(side)])
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    once, again = (packing.digest(packing.pack(d, PACKING)) for d in (docs, docs.repartition(3, "n_chars")))
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_ranges_follow_the_rows(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w', id, ' and more') as text")
    few = packing.pack(docs, PACKING.__class__(PACKING.tokenizer, docs_per_range=10))
    assert few.rdd.getNumPartitions() == 40 and few.selectExpr("count(distinct sequence_id >> 40) as n").first()["n"] > 20


def test_pack(spark):
    data = [(i, t, 7) for i, t in enumerate(ODD)] + [(0, "same", 7), (0, "same", 7), (None, "x y z", 7)]
    rows = packing.pack(spark.createDataFrame(data, "doc_id bigint, text string, length int"), PACKING).collect()
    whole = Tokenizer.from_file(PACKING.tokenizer)
    assert sum(r["length"] for r in rows) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in data)
    seqs = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n & (n - 1) == 0 for n in seqs.values())
    texts = {i: t or "" for i, t, _ in data[:-3]}
    for r in rows:  # each piece has its document's ids
        if r["doc_id"] in texts and r["doc_id"] != 0:
            ids = [*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PACKING).count() == 0
