import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import chunk_encoding as ce
from lodegraph.llm.vocab import BYTE_BPE_50K, encoding

pytest.importorskip("tiktoken")
ENC = encoding(BYTE_BPE_50K)
PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "a", "bc", "word", "'s", "'", "'re", "'ll", "1", "22", "!", ".", "é", "関数", "の", "\u00a0", "\u3000", "😀", "x", "-", "\r\n", "ش", "\u200b", "<|endoftext|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, min_size=1, max_size=12).map("".join), min_size=1, max_size=6))
def test_repaired_joins_are_exact(parts):
    pieces = [(p, np.array(ENC.encode_ordinary(p), np.uint16)) for p in parts]
    got = [int(t) for a in ce.join_repaired(pieces, ENC) for t in a]
    assert got == ENC.encode_ordinary("".join(parts))


def chunks_of(texts):
    """(document, place, chunk) of every place, from the map side alone."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["d", "h", "t"])
    out = []
    for b in ce._chunks(iter([batch])):
        for r in b.to_pylist():
            out += [(int(p["doc_id"]), int(p["seq"]), r["chunk"]) for p in np.frombuffer(r["places"], ce.PLACE)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=400).map("".join), min_size=1, max_size=5))
def test_cuts_keep_the_text_and_its_characters(texts):
    back = chunks_of(texts)
    assert ["".join(c for d, _, c in back if d == i) for i in range(len(texts))] == texts
    assert all([k for d, k, _ in back if d == i] == list(range(sum(d == i for d, _, _ in back))) for i in range(len(texts)))


def test_cuts_follow_the_content():
    shared = " ".join(f"passage number {i} of the shared text" for i in range(200))
    back = chunks_of(["short start. " + shared, "another and quite different start of it. " + shared])
    one, two = ({c for d, _, c in back if d == i} for i in (0, 1))
    assert len(one & two) > 0.8 * len(one)


def documents(spark, data):
    return spark.createDataFrame([(*r, 1, "c") for r in data], "doc_id bigint, text string, seq int, chunk string")


def test_whole_corpus_equals_direct_encoding(spark):
    long = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(20_000))
    texts = {1: None, 2: "", 3: " ", 4: "a", 5: "x" * 50_000, 6: long, 7: "It's  they're\n\n\n" * 900, 8: "<|endoftext|> is text", 9: "The same passage. " * 400, 10: "The same passage. " * 400, 11: "\n" * 9000, 12: "é" * 5001}
    got = {r["doc_id"]: r["ids"] for r in ce.encode_corpus(documents(spark, [*texts.items(), (9, texts[9])])).collect()}
    assert got == {k: ENC.encode_ordinary(t or "") for k, t in texts.items()}


@pytest.mark.parametrize("hot, memory, rows, window", [(1, 100, 3, 1), (11, 10**6, 8192, 5000), (1000, 2000, 2, 10**8)])
def test_hot_chunks_small_memories_and_windows(spark, monkeypatch, hot, memory, rows, window):
    for name, value in (("HOT_PLACES", hot), ("MEMORY_CHARS", memory), ("OUT_ROWS", rows), ("WINDOW_BYTES", window), ("CUT_DOCUMENTS", 5)):
        monkeypatch.setattr(ce, name, value)
    texts = {i: "License text that everybody copies, word by word. " * 60 + f"own end {i}" for i in range(12)} | {20: "", 21: None, 22: "ab" * 3000}
    # the closures are called here, so that the changed bounds hold; Spark's workers import the module anew
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([0 if not t else hash(t) for t in texts.values()]), pa.array(list(texts.values()))], names=["d", "h", "t"])
    placed = pa.Table.from_batches(list(ce._encoder(BYTE_BPE_50K)(ce._chunks(iter([batch])))))
    placed = pa.concat_tables([placed, placed]).sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("seq", "ascending")])
    got = [r for b in ce._assembler(BYTE_BPE_50K)(iter(placed.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    assert len(got) == len(texts) and {r["doc_id"]: r["ids"] for r in got} == {k: ENC.encode_ordinary(t or "") for k, t in texts.items()}


def test_documents_without_an_id_and_several_texts(spark):
    df = ce.encode_corpus(documents(spark, [(None, "a b"), (None, "a b"), (0, "a b"), (3, None), (3, ""), (3, "c")]))
    assert sorted(((r[0], r[1]) for r in df.collect()), key=repr) == sorted([(None, ENC.encode_ordinary("a b")), (0, ENC.encode_ordinary("a b")), (3, []), (3, ENC.encode_ordinary("c"))], key=repr)


def test_every_document_comes_out_once(spark):
    df = ce.encode_corpus(documents(spark, [(1, "a b"), (1, "a b"), (2, None), (2, None)]))
    assert sorted((r[0], len(r[1])) for r in df.collect()) == [(1, 2), (2, 0)] and df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert ce.encode_corpus(documents(spark, [])).collect() == []


def test_counts(spark):
    got = dict(tuple(r) for r in ce.token_counts(documents(spark, [(1, "one two"), (2, None), (3, ""), (1, "one two")])).collect())
    assert got == {1: 2, 2: 0, 3: 0}
