"""Benchmark decontamination: an FM-index per training shard, searched backwards for every window of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, by_bytes, lookup, row_keyed, tidy
from trackloom.llm.fm_index import FMIndex
from trackloom.llm.hashing import blocks as cuts

#: Words of a window.
WINDOW = 8
#: Benchmark bytes that one pass over the corpus searches for, about: what a worker holds grows with no benchmark.
BLOCK_BYTES = 8 << 20
#: Words of a piece of a benchmark item; pieces overlap, so that they have all its windows.
PIECE_WORDS = 1 << 16
#: Symbols of a shard's index, about, words that one shard reads, and bytes of text that it holds.
SHARD_SYMBOLS = 1 << 20
SHARD_WORDS = 1 << 22
SHARD_BYTES = 32 << 20

#: Word bytes (A-Z lower-cased); every other byte separates.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, so many at a time that a long text's are never held at once."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES) + b" "
    for a, e in cuts(raw):
        yield raw[a:e].split()


class Windows:
    """The distinct windows of pieces of items as rows of symbols, and the items that have each."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in pieces})
        at = {i: k for k, i in enumerate(self.ids)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, ws in pieces:
            if ws:
                # 0 ends the indexed text and 1 stands for every other word
                s = np.array([self.symbols.setdefault(w, len(self.symbols) + 2) for w in ws], np.int32)
                s = np.r_[np.zeros(max(0, window - len(s)), np.int32), s]
                rows.append(np.lib.stride_tricks.sliding_window_view(s, window))
                owners.append(np.full(len(rows[-1]), at[item]))
        flat, owner = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners)
        _, first, which = np.unique(flat.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.patterns = flat[first]
        self.lengths = (self.patterns > 0).sum(1)
        pairs = np.unique(which.astype(np.int64) * max(1, len(self.ids)) + owner)
        self.owner_flat = pairs % max(1, len(self.ids))
        self.owner_start = np.searchsorted(pairs // max(1, len(self.ids)), np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min(initial=window))

    def read(self, text: str | None) -> np.ndarray:
        """A text's words as symbols."""
        parts = [np.fromiter(map(self.symbols.get, ws, repeat(1)), np.int32, len(ws)) for ws in word_lists(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def benchmark_blocks(scratch: Scratch, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, words, block): pieces of the benchmark's items, dealt to blocks of about ``block_bytes``, and how many blocks
    there are. They are made in tasks; the driver reads a block at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws, short = [], True
                for more in word_lists(text):
                    ws += more
                    while len(ws) >= PIECE_WORDS + window:
                        yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([b" ".join(ws[:PIECE_WORDS])], pa.binary())], ["item", "words"])
                        ws, short = ws[PIECE_WORDS - window + 1 :], False
                if short or len(ws) >= window:
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([b" ".join(ws)], pa.binary())], ["item", "words"])

    cut = scratch.save(items.mapInArrow(tidy(pieces), "item string, words binary").where(F.octet_length("words") > 0), "pieces")
    total = cut.agg(F.sum(F.octet_length("words") + F.lit(16))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))), n


def compacted(s: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of ``s`` that the index keeps: runs of at least ``shortest`` benchmark words, and one word before each.

    A shorter run cannot hold a window, so it is read as an unknown word; a row of unknown words is one symbol.
    """
    known = np.r_[False, s > 1, False]
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, stop = edge[::2], edge[1::2]
    long_ = stop - start >= shortest
    keep = np.zeros(len(s) + 1, np.int32)
    np.add.at(keep, start[long_], 1)
    np.add.at(keep, stop[long_], -1)
    keep = np.cumsum(keep[:-1]) > 0
    s[~keep] = 1
    return np.flatnonzero(keep | np.r_[keep[1:], False])


def search_shard(docs: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans (doc, first word, word after the last) and the pairs (doc, item) of one shard."""
    counts = np.array([len(d) for d in docs], np.int64)
    base = np.r_[0, np.cumsum(counts + 1)]
    s = np.ones(base[-1], np.int32)  # an unknown word between documents
    for b, d in zip(base.tolist(), docs, strict=False):
        s[b : b + len(d)] = d
    at = compacted(s, windows.shortest)
    none = np.empty(0, np.int64)
    if not len(at) or not len(windows.patterns):
        return none, none, none, none, none
    index = FMIndex(s[at])
    low, high = index.search(windows.patterns, windows.lengths)
    hits = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(hits)), hits)
    rows = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + low[which]
    start = at[index.locate(rows)]
    stop = start + windows.lengths[which]
    doc = np.searchsorted(base, start, side="right") - 1
    # items: each pair of a document and a window once, then the window's items
    pair = np.unique(doc * len(hits) + which)
    pd, pw = pair // len(hits), pair % len(hits)
    n = windows.owner_start[pw + 1] - windows.owner_start[pw]
    flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(windows.owner_start[pw], n)
    items = np.unique(np.repeat(pd, n) * len(windows.ids) + windows.owner_flat[flat])
    # spans of one document that touch or overlap are one; the separator keeps documents apart
    order = np.argsort(start, kind="stable")
    start, stop, doc = start[order], np.maximum.accumulate(stop[order]), doc[order]
    first = np.r_[True, start[1:] > stop[:-1]] if len(start) else np.empty(0, bool)
    last = np.r_[first[1:], True] if len(start) else first
    return doc[first], start[first] - base[doc[first]], stop[last] - base[doc[first]], items // len(windows.ids), items % len(windows.ids)


def shards(batches: Iterator[pa.RecordBatch], text_at: int, windows: Windows) -> Iterator[tuple[pa.Table, list[int], list[list[tuple[int, int]]], list[set[str]]]]:
    """Consecutive rows, searched together: their number of words, spans and items."""

    def searched(rows: list[pa.RecordBatch], parts: list[np.ndarray]):
        spans: list[list[tuple[int, int]]] = [[] for _ in parts]
        items: list[set[str]] = [set() for _ in parts]
        doc, start, stop, item_doc, item = search_shard(parts, windows)
        for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
            spans[d].append((a, b))
        for d, i in zip(item_doc.tolist(), item.tolist(), strict=True):
            items[d].add(windows.ids[i])
        return pa.Table.from_batches(rows).combine_chunks(), [len(p) for p in parts], spans, items

    rows, parts, symbols, total, size = [], [], 0, 0, 0
    for piece in by_bytes(batches, text_at, 512):
        rows.append(piece)
        for text in piece.column(text_at).to_pylist():
            parts.append(windows.read(text))
            symbols += int(np.count_nonzero(parts[-1] > 1)) // 4
            total += len(parts[-1])
            size += len(text or "")
        if symbols >= SHARD_SYMBOLS or total >= SHARD_WORDS or size >= SHARD_BYTES:
            yield searched(rows, parts)
            rows, parts, symbols, total, size = [], [], 0, 0, 0
    if rows:
        yield searched(rows, parts)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def finished(table: pa.Table, names: list[str], remove: bool, n_words: list[int], spans: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    """The rows with their result columns, and without the spans' bytes if they are to be removed."""
    cols = [whole(table.column(c)) for c in names]
    if remove and any(spans):
        k = names.index("text")
        texts = cols[k].to_pylist()
        for i, x in enumerate(spans):
            if x:
                texts[i] = without(texts[i], x)
        cols[k] = pa.array(texts, cols[k].type)
    ends = lambda k: pa.array([[x[k] for x in own] for own in spans], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), ends(0), ends(1), pa.array(items, pa.list_(pa.string()))], [*names, *NEW])


NEW = ["n_words", "span_start", "span_stop", "items"]
SPANS = "span_start array<long>, span_stop array<long>, items array<string>"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, remove: bool = False) -> DataFrame:
    """Add to each row of ``docs`` (any columns and text) what windows of ``benchmark`` (item_id, text) occur in it.

    New columns: n_words; span_start and span_stop, the removal spans in words (merged, ascending, stop exclusive);
    items, the ids of items with an occurring window as strings in string order. Columns of these names in ``docs`` are
    replaced. Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or all its words if it has fewer. With ``remove``, text comes without the
    bytes from each span's first word to its last.

    Null, empty and wordless texts have no words and match nothing, on either side; a null item id is ``null``. Repeated
    rows get equal results; items that repeat or share windows are all named. Empty ``docs`` give an empty result, an
    empty benchmark no spans. A text of any length is read whole, a piece of its words at a time.

    A benchmark of any size is cut into blocks of about ``block_bytes``. One block is searched in one pass; with more,
    each takes a pass of its own over the corpus, whose spans are saved, and the last pass brings them together.
    """
    spark, docs = docs.sparkSession, docs.drop(*NEW)
    scratch, names = Scratch(spark, "decontaminate"), docs.columns
    made, n = benchmark_blocks(scratch, benchmark, window, block_bytes)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def load(k: int):
        got = made.where(F.col("block") == k).select("item", "words").toArrow()
        pieces = zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)
        return spark.sparkContext.broadcast(Windows([(i, w.split()) for i, w in pieces], window))

    if n == 1:
        shared = load(0)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, n_words, spans, items in shards(batches, names.index("text"), shared.value):
                yield finished(table, names, remove, n_words, spans, [sorted(x) for x in items])

        return docs.mapInArrow(tidy(search), f"{kinds}, n_words long, {SPANS}")

    held_whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("document"), "text")
    docs = row_keyed(scratch, held_whole, "_file", "_row")
    for k in range(n):
        held = load(k)

        def hits(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for table, _, spans, items in shards(batches, 2, held.value):
                at = [i for i, x in enumerate(spans) if x]
                ends = lambda j: pa.array([[x[j] for x in spans[i]] for i in at], pa.list_(pa.int64()))  # noqa: E731, B023
                own = [whole(table.column(c)).take(pa.array(at, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, ends(0), ends(1), pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))], ["_file", "_row", *NEW[1:]])

        found = docs.select("_file", "_row", "text").mapInArrow(tidy(hits), f"_file long, _row long, {SPANS}")
        found.write.parquet(scratch.path(f"hits/block={k}"))
        held.destroy()
    found = spark.read.parquet(scratch.path("hits")).groupBy("_file", "_row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in NEW[1:]))
    joined = lookup(docs.drop("text"), scratch.save(found, "found"), ["_file", "_row"], "left").select("document.*", *NEW[1:])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, names.index("text")):
            start, stop, items = (b.column(len(names) + k).to_pylist() for k in range(3))
            n_words = [sum(map(len, word_lists(t))) for t in b.column(names.index("text")).to_pylist()]
            spans = [union(list(zip(s or [], e or [], strict=True))) for s, e in zip(start, stop, strict=True)]
            yield finished(pa.Table.from_batches([b]), names, remove, n_words, spans, [sorted(set(x or [])) for x in items])

    return joined.mapInArrow(tidy(merge), f"{kinds}, n_words long, {SPANS}")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes of these spans of words."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, b.view(np.int8), 0]))
    first, last = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : first[s]])
        at = last[e - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def digest(docs: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (at least ``least_items`` items) of the spans."""
    hit = F.aggregate(F.arrays_zip("span_start", "span_stop"), F.lit(0).cast("long"), lambda a, x: a + x["span_stop"] - x["span_start"])
    n = F.size("items").cast("long")
    return docs.select("doc_id", "n_words", hit.alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))

