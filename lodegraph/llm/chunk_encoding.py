"""Encoding of a corpus by content-defined chunk reuse.

1. ``cut``: a gear hash rolls over the UTF-8 bytes; where its leading bits vanish, the text is cut, so
   equal passages are cut alike in whatever document they stand.  A cut moves on to the next place
   between a non-blank and a blank before a letter, if one is near: no token can span such a place.
2. Equal chunks meet: a map task sends each of its distinct chunks once, with the packed places where it
   stands, to the partition of the chunk's hash, where each distinct text is encoded once.
3. The token lists return to their documents, sorted by place.  A join that was not cut at such a safe
   place is repaired: the untrusted end of the left chunk and the start of the right one are split again,
   and this goes on until a piece boundary of the new split coincides with one of the right chunk's own.
   Splitting looks only forward, so from a common boundary on both agree to the token.

The documents are read once.  Shuffled are the distinct chunk texts with about 21 bytes a place, then two
bytes per token.  Hashes only choose partitions; tokens are looked up by the text itself, so no collision
can exchange them.  A chunk that is frequent within a map task is encoded once per ``TASKS_PER_SALT`` map
tasks instead of once in all, so that one partition never receives the places of a third of the corpus.

Defined results
---------------
* Null and empty texts give an empty list.  Strings of special tokens are ordinary text.
* Repeated rows (same doc_id and text) give one row.  Several texts of one doc_id give a row each.
* A text without any cut (one byte repeated, say) is cut every ``MAX_CHUNK`` bytes and repaired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.vocab import BYTE_BPE_50K, encoding, splitter

MIN_CHUNK, MASK_BITS, MAX_CHUNK, SAFE_WITHIN = 96, 9, 4096, 96
#: Bytes of text among which a map task finds equal chunks, and documents of a batch that are cut together.
WINDOW_BYTES, CUT_DOCUMENTS = 32_000_000, 2000
#: A chunk with more places in one window is spread over several partitions, one for so many map tasks.
HOT_PLACES, TASKS_PER_SALT = 16, 64
#: Characters of distinct chunks that an encoding task remembers; beyond, a chunk may be encoded again.
MEMORY_CHARS = 64_000_000
OUT_ROWS = 8192
WINDOW_DOUBLINGS = 5  # 32 bytes

_GEAR = np.random.default_rng(0x5EED).integers(0, 2**32, 256, dtype=np.uint32)


def _blank_or_high(b: np.ndarray) -> np.ndarray:
    return (b <= 0x20) | (b >= 0x80)


def _letter(b: np.ndarray) -> np.ndarray:
    return ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Cut positions inside each text of a byte buffer, and whether each is a safe place."""
    if len(data) == 0:
        return [np.array([], np.int64)] * len(starts), [np.array([], bool)] * len(starts)
    h = _GEAR[data]
    for k in range(WINDOW_DOUBLINGS):
        m = 1 << k
        shifted = np.zeros_like(h)
        shifted[m:] = h[:-m] << np.uint32(m)
        h = h + shifted
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0)
    safe = np.zeros(len(data), bool)
    if len(data) > 2:
        safe[1:-1] = (data[1:-1] == 0x20) & ~_blank_or_high(data[:-2]) & _letter(data[2:])
    safe_at = np.flatnonzero(safe)
    following = np.append(safe_at, len(data) + 2 * SAFE_WITHIN)[np.searchsorted(safe_at, marks)]
    where = np.where(following - marks <= SAFE_WITHIN, following, marks)
    inner = (data & 0xC0) == 0x80
    all_cuts, all_safe = [], []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        out, last = [], s
        for p in where[np.searchsorted(marks, s) : np.searchsorted(marks, e)].tolist():
            while p - last > MAX_CHUNK:
                last += MAX_CHUNK
                while inner[last]:
                    last -= 1
                out.append(last)
            while p < e and inner[p]:
                p += 1
            if p - last >= MIN_CHUNK and e - p >= MIN_CHUNK:
                out.append(p)
                last = p
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            while inner[last]:
                last -= 1
            out.append(last)
        at = np.array(out, np.int64)
        all_cuts.append(at - s)
        all_safe.append(safe[at])
    return all_cuts, all_safe


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(bounds[0]) if len(bounds) else 0
    return raw[first : int(bounds[-1])] if len(bounds) else raw, bounds[:-1] - first, bounds[1:] - first


#: Where a chunk stands: document, hash of the whole text, number of the chunk; flags below.
PLACE = np.dtype([("doc_id", "<i8"), ("text_hash", "<i8"), ("seq", "<i4"), ("flags", "<u1")])
#: The join to the chunk before is safe; the text is needed to repair a join; the document has no id.
SAFE, KEPT, NO_ID = 1, 2, 4

CHUNK_SCHEMA = "salt int, chunk string, places binary"


def _cut_batch(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All chunks of some documents (doc_id, text_hash, text) and their places; an empty text is one empty chunk."""
    data, starts, ends = _buffers(batch.column(2).fill_null(""))
    cuts, safes = cut(data, starts, ends)
    counts = np.array([len(c) + 1 for c in cuts])
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    begin = np.repeat(starts, counts)
    safe = np.ones(len(rows), bool)  # the join to the chunk before
    inside = np.ones(len(rows), bool)
    inside[first] = False
    begin[inside] += np.concatenate(cuts)
    safe[inside] = np.concatenate(safes)
    after = np.append(safe[1:], True)
    after[first + counts - 1] = True
    places = np.zeros(len(rows), PLACE)
    doc = batch.column(0)
    places["doc_id"] = doc.fill_null(0).to_numpy()[rows]
    places["text_hash"] = batch.column(1).to_numpy()[rows]
    places["seq"] = np.arange(len(rows)) - np.repeat(first, counts)
    no_id = doc.is_null().to_numpy(zero_copy_only=False)[rows]
    places["flags"] = SAFE * safe + KEPT * ~(safe & after) + NO_ID * no_id
    offsets = np.append(begin, len(data)).astype(np.int64)
    chunk = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return chunk, places


def _gathered(chunks: list[pa.Array], places: list[np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    """Each distinct chunk of a window with all its places."""
    coded = pa.concat_arrays(chunks).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    bounds = np.cumsum(np.append(0, np.bincount(code, minlength=len(coded.dictionary))))
    packed = np.concatenate(places)[order].tobytes()
    size = PLACE.itemsize
    for at in range(0, len(coded.dictionary), OUT_ROWS):
        b = bounds[at : at + OUT_ROWS + 1]
        salts = np.where(np.diff(b) > HOT_PLACES, salt, 0).astype(np.int32)
        where = pa.array([packed[i * size : j * size] for i, j in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)], pa.binary())
        text = coded.dictionary.slice(at, OUT_ROWS).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(salts), text, where], names=["salt", "chunk", "places"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    salt = 1 + (context.partitionId() if context else 0) // TASKS_PER_SALT
    chunks, places, held = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, CUT_DOCUMENTS):
            chunk, place = _cut_batch(whole.slice(at, CUT_DOCUMENTS))
            chunks.append(chunk)
            places.append(place)
            held += chunk.nbytes
            if held > WINDOW_BYTES:
                yield from _gathered(chunks, places, salt)
                chunks, places, held = [], [], 0
    if chunks:
        yield from _gathered(chunks, places, salt)


TOKENS_SCHEMA = "doc_id bigint, text_hash bigint, seq int, safe boolean, ids binary, chunk string"


def _encoder(path: str):
    """Chunks with places -> one row per place with the chunk's tokens, two bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        known: dict[str, bytes] = {}
        chars = 0
        for b in batches:
            ids = []
            for text in b.column(1).to_pylist():
                got = known.get(text)
                if got is None:
                    got = np.array(enc.encode_ordinary(text), np.uint16).tobytes()
                    chars += len(text)
                    if chars > MEMORY_CHARS:
                        known, chars = {}, len(text)
                    known[text] = got
                ids.append(got)
            packed = b.column(2).to_pylist()
            places = np.frombuffer(b"".join(packed), PLACE)
            rows = np.repeat(np.arange(len(packed)), [len(p) // PLACE.itemsize for p in packed])
            ids, flags = pa.array(ids, pa.binary()), places["flags"]
            for at in range(0, len(rows), OUT_ROWS):
                p, f, r = places[at : at + OUT_ROWS], flags[at : at + OUT_ROWS], rows[at : at + OUT_ROWS]
                kept = pa.array(r, mask=f & KEPT == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p["doc_id"], mask=f & NO_ID != 0), pa.array(p["text_hash"]), pa.array(p["seq"]), pa.array(f & SAFE != 0),
                        ids.take(pa.array(r)), b.column(1).take(kept),
                    ],
                    names=[c.split()[0] for c in TOKENS_SCHEMA.split(", ")],
                )

    return encode


def join_repaired(pieces: list[tuple[str, np.ndarray]], enc) -> list[np.ndarray]:
    """Tokens of the concatenated texts, from (text, tokens of the text alone), neighbours unsafe."""
    split = splitter()
    count = lambda text: len(enc.encode_ordinary(text))
    done: list[np.ndarray] = []
    text, tokens = pieces[0]
    for right, right_tokens in pieces[1:]:
        # trusted: pieces of the left split whose look-ahead lies inside the left text
        trusted = 0
        for m in split.finditer(text, max(0, _split_start(split, text))):
            if m.end() >= len(text) or m.start() + 3 > len(text):
                break
            trusted = m.end()
        tail = text[trusted:]
        done.append(tokens[: len(tokens) - count(tail)])
        both = tail + right
        own_scan = split.finditer(right)
        own, own_end, skip = {0: 0}, 0, 0  # own boundary -> tokens of the right chunk before it
        fresh: list[int] = []
        met = -1
        for m in split.finditer(both):
            if m.end() >= len(both) or m.start() + 3 > len(both):
                break
            # piece by piece: a prefix of several could split otherwise at its end
            fresh += enc.encode_ordinary(m.group())
            at = m.end() - len(tail)
            while own_end < at and (o := next(own_scan, None)):
                own_end, skip = o.end(), skip + count(o.group())
                own[own_end] = skip
            if at in own:
                met = at
                break
        if met < 0:
            text, tokens = both, np.array(enc.encode_ordinary(both), np.uint16)
        else:
            done.append(np.array(fresh, np.uint16))
            text, tokens = right[met:], right_tokens[own[met] :]
    done.append(tokens)
    return done


def _split_start(split, text: str) -> int:
    """A boundary of the text's own split not far from its end, or 0.

    A blank before a letter and after a visible ASCII character starts a piece wherever it stands.
    """
    at = len(text) - 24
    while at > 24:
        at = text.rfind(" ", 1, at)
        if at < 1:
            return 0
        before, after = text[at - 1], text[at + 1]
        if "!" <= before <= "~" and after.isascii() and after.isalpha():
            return at
    return 0


def _changes(t: pa.Table | pa.RecordBatch, *columns: int) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        column = t.column(c)
        value, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_null().to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def _assembled(t: pa.Table, enc) -> pa.RecordBatch:
    """Whole documents, their rows in order, as doc_id and ids."""
    t = t.filter(pa.array(_changes(t, 0, 1, 2)))  # repeated rows of the input stand side by side
    first = np.flatnonzero(_changes(t, 0, 1))
    safe = t.column(3).to_numpy()
    ids, texts = t.column(4).to_pylist(), t.column(5)
    broken = ~safe
    broken[first] = False
    n_broken = np.append(0, np.cumsum(broken))
    out, lengths = [], []
    for lo, hi in zip(first.tolist(), np.append(first, t.num_rows)[1:].tolist(), strict=True):
        if n_broken[lo] == n_broken[hi]:
            whole = b"".join(ids[lo:hi])
        else:
            parts, j = [], lo
            while j < hi:
                k = j + 1
                while k < hi and broken[k]:
                    k += 1
                if k == j + 1:
                    parts.append(ids[j])
                else:
                    pieces = [(texts[x].as_py(), np.frombuffer(ids[x], np.uint16)) for x in range(j, k)]
                    parts += [piece.tobytes() for piece in join_repaired(pieces, enc)]
                j = k
            whole = b"".join(parts)
        out.append(whole)
        lengths.append(len(whole) // 2)
    tokens = np.frombuffer(b"".join(out), np.uint16).astype(np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    doc = t.column(0).take(pa.array(first)).combine_chunks()
    return pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(offsets, pa.array(tokens))], names=["doc_id", "ids"])


def _assembler(path: str):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
        held: list[pa.RecordBatch] = []  # the last one ends in a document that may go on
        for b in batches:
            if not b.num_rows:
                continue
            if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
                yield _assembled(pa.Table.from_batches(held), enc)
                held = []
            last = int(np.flatnonzero(_changes(b, 0, 1))[-1])
            if last:
                yield _assembled(pa.Table.from_batches([*held, b.slice(0, last)]), enc)
                held = []
            held.append(b.slice(last))
        if held:
            yield _assembled(pa.Table.from_batches(held), enc)

    return assemble


def encode_corpus(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id bigint, ids array<int>) of every document."""
    text_hash = F.when(F.col("text") != "", F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash.alias("text_hash"), "text")
    chunks = docs.mapInArrow(_chunks, CHUNK_SCHEMA)
    placed = chunks.repartition(F.xxhash64("chunk"), "salt").mapInArrow(_encoder(path), TOKENS_SCHEMA)
    in_order = placed.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "seq")
    return in_order.mapInArrow(_assembler(path), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none. No shuffle of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = docs.mapInArrow(count, "doc_id bigint, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
