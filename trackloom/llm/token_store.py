"""Token ids in fixed-width bit packing: a binary file format with block offsets, a writer and a reader."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import Scratch, by_bytes, lookup, tidy
from trackloom.llm.hashing import BASE, BLOCK
from trackloom.llm.hashing import blocks as cuts
from trackloom.llm.hashing import mixed

MAGIC = b"TLBP1\0\0\0"
#: magic, bits of an id, ids of a block, documents, ids, blocks
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 1 << 16
#: A file ends at the first document that brings it to this many ids; a document is never split over files.
FILE_IDS = 1 << 21
#: Distinct chunks whose ids a task remembers.
MEMORY = 800_000
#: A batch of which more than one in so many chunks is a new one is encoded as whole texts.
FRESH = 2
#: Chunks of letters that are encoded as one line.
LINE = 64
#: Bits of a slot number of the chunk table, and slots in which a chunk can stand. Longer chunks than SHORT bytes, and
#: those that find no slot, are looked up one by one.
SLOT_BITS, PROBES, SHORT = 21, 8, 16


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width as consecutive fields of ``width`` bits, little end first, padded to whole bytes; larger ids
    raise an error."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} does not fit {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``pack``'s bytes, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> bytes:
    """Head; document table (ids, null flags, lengths); byte offset of each block and of the end; packed blocks."""
    blocks = [pack(ids[a : a + block_ids], width) for a in range(0, len(ids), block_ids)]
    null = np.array([x is None for x in doc_ids], np.uint8)
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + null.tobytes() + lengths.astype("<u8").tobytes()
    first = HEAD.size + len(table) + 8 * (len(blocks) + 1)
    offsets = first + np.cumsum([0, *map(len, blocks)])
    return HEAD.pack(MAGIC, width, block_ids, len(doc_ids), len(ids), len(blocks)) + table + offsets.astype("<u8").tobytes() + b"".join(blocks)


class TokenFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.width, self.block_ids, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, self.data = HEAD.size, memoryview(data)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(data, "<i8", docs, at), null, strict=True)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        parts = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], self.width, min(self.block_ids, self.n_ids - k * self.block_ids)) for k in range(a, b + 1)]
        return np.concatenate(parts)[start - a * self.block_ids : stop - a * self.block_ids]


LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def plain(text: str | None) -> bytes:
    """UTF-8 bytes of a text, A-Z lower-cased and with spaces for its ASCII white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    # upper case matters where a special token could be spelled, and before a combining mark
    exact = b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw
    return raw.translate(SPACES if exact else LOWER)


class Chunks:
    """Where the chunks between the spaces of ``raw`` are, and the first and the last 8 bytes of each as numbers, which
    with its length say all of a chunk of up to SHORT bytes."""

    def __init__(self, raw: bytes):
        self.raw = raw
        space = np.frombuffer(raw, np.uint8) == 32
        self.start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        self.stop = np.flatnonzero(space & np.r_[False, ~space[:-1]])
        self.size = self.stop - self.start
        eight = np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))
        self.first = eight[self.start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(self.size, 8).astype(np.uint64)))
        self.last = np.where(self.size > 8, eight[np.maximum(self.stop - 8, 0)], 0)
        self.key = mixed(self.first + self.last * np.uint64(BASE) + self.size.astype(np.uint64)) | np.uint64(1)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.stop[k]]


class ChunkTable:
    """Numbers of chunks, in slots by a hash; whole batches are looked up at once, and each hit compared in full."""

    def __init__(self):
        self.key, self.number = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        self.own = np.zeros((1 << SLOT_BITS, 2), np.uint64)
        self.size = np.zeros(1 << SLOT_BITS, np.int64)

    def slots(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + probe) & ((1 << SLOT_BITS) - 1)

    def add(self, chunks: list[bytes], first: int) -> None:
        """Give ``chunks``, which are not in the table, the numbers from ``first``."""
        c = Chunks(b" ".join(chunks) + b" ")
        left = np.flatnonzero(c.size <= SHORT)
        for probe in range(PROBES):
            slot = self.slots(c.key[left], probe)
            free = np.flatnonzero(self.key[slot] == 0)
            slot, one = np.unique(slot[free], return_index=True)
            taken = free[one]
            mine = left[taken]
            self.key[slot], self.number[slot], self.size[slot] = c.key[mine], mine + first, c.size[mine]
            self.own[slot, 0], self.own[slot, 1] = c.first[mine], c.last[mine]
            left = np.delete(left, taken)
            if not len(left):
                break

    def find(self, c: Chunks) -> np.ndarray:
        """The chunks' numbers, -1 where the table doesn't have one."""
        out = np.full(len(c), -1, np.int64)
        left = np.flatnonzero(c.size <= SHORT)
        for probe in range(PROBES):
            slot = self.slots(c.key[left], probe)
            there = self.key[slot]
            same = there == c.key[left]
            at, k = slot[same], left[same]
            full = (self.own[at, 0] == c.first[k]) & (self.own[at, 1] == c.last[k]) & (self.size[at] == c.size[k])
            out[k[full]] = self.number[at[full]]
            left = left[~same & (there != 0)]
            if not len(left):
                break
        return out


#: Normalisers that change no white space into anything else or the reverse, and a pattern of words
#: none of which holds white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer file, by its parts, lower-cases, drops white space and never joins over it."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    flat = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    normal, split = flat(t["normalizer"], "normalizers"), flat(t["pre_tokenizer"], "pretokenizers")
    words = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    return (
        all(n in NORMALIZERS for n in normal)
        and {"type": "Lowercase"} in normal
        and split[:1] == [words]
        and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in split[1:])
        and t["model"]["type"] == "BPE"
        and not t["model"]["dropout"]
        and not (t["truncation"] or t["padding"])
        and all(a["content"].startswith("<|") and not (set(a["content"]) & set(" \t\n\r\x0b\f")) and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in t["added_tokens"])
    )


class ChunkEncoder:
    """Encodes texts chunk by chunk between ASCII white space, with a memory of the chunks already seen.

    This gives what encoding the whole text gives for tokenizers that lower-case, drop white space and never join over
    it; ``whole_words`` asks for it, and is an error for any other tokenizer. By default it is used where it can be,
    and whole texts are encoded elsewhere.
    """

    def __init__(self, path: str, whole_words: bool | None):
        from tokenizers import Tokenizer

        fits = drops_white_space(path) if whole_words is not False else False
        if whole_words and not fits:
            raise ValueError(f"{path} may join words over white space, so whole texts must be encoded")
        self.tokenizer, self.whole_words = Tokenizer.from_file(path), fits
        suffix, self.ends = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes = [np.zeros(1, np.uint32)], [np.ones(1, np.int64)]
        self.seen = np.zeros(1, np.int64)
        self.joined = None
        self.table = ChunkTable()

    def thin(self) -> None:
        """Forget chunks that were met once only since they were learnt, or all if that frees too little."""
        self.tables()
        kept = [(c, k) for c, k in self.known.items() if k < len(self.seen) and self.seen[k] > 1]
        if len(kept) > MEMORY // 2:
            self.forget()
            return
        self.known = {c: n for n, (c, _) in enumerate(kept, 1)}
        at = np.array([0, *(k for _, k in kept)])
        ids, size = self.ids_of(at)
        self.flat, self.sizes, self.joined = [ids], [size], None
        self.seen = np.ones(len(at), np.int64)
        self.table = ChunkTable()
        self.table.add([c for c, _ in kept], 1)

    def add(self, new: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known) + 1
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.table.add(new, first)
        self.flat.append(ids.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))
        self.joined = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are known, and the start and number of each chunk's."""
        if self.joined is None:
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
            self.joined = self.flat[0], np.cumsum(self.sizes[0]) - self.sizes[0], self.sizes[0]
        return self.joined

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, sizes = self.tables()
        size = sizes[at]
        return flat[np.arange(size.sum()) + np.repeat(starts[at] - (np.cumsum(size) - size), size)], size

    def learn_apart(self, new: list[bytes]) -> None:
        """Encode chunks as words of their own: exact for any chunk."""
        got = self.tokenizer.encode([c.decode("utf-8", "replace") for c in new], is_pretokenized=True, add_special_tokens=False)
        self.add(new, np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(new)))

    def learn_letters(self, new: list[bytes]) -> None:
        """Encode chunks of letters in lines, which is faster: each is one word, and its last token says so."""
        lines = [new[a : a + LINE] for a in range(0, len(new), LINE)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable(got)), np.int64)
        stop = np.flatnonzero(self.ends[ids]) + 1
        ends = np.cumsum([len(g) for g in got])
        per = np.diff(np.searchsorted(stop, np.r_[0, ends], side="right"))
        whole = (per == [len(x) for x in lines]) & np.isin(ends, stop)
        if whole.all():
            self.add(new, ids, np.diff(stop, prepend=0))
            return
        for line, g, ok in zip(lines, got, whole.tolist(), strict=True):
            if ok:
                self.add(line, np.array(g), np.diff(np.flatnonzero(self.ends[g]) + 1, prepend=0))
            else:
                self.learn_apart(line)

    def learn(self, new: list[bytes]) -> None:
        if self.ends is None:
            self.learn_apart(new)
            return
        marked = [c for c in new if c[-1] in b",."]
        stems = [c[:-1] for c in marked]
        bare = {c for c in {*new, *stems}.difference(marked) if c and (c.isalpha() or c.decode("utf-8", "replace").isalpha())}
        letters = list(bare.difference(self.known))
        joined_ = [(c, s) for c, s in zip(marked, stems, strict=True) if s in bare]
        apart = set(new).difference(bare, (c for c, _ in joined_)) | {c[-1:] for c, _ in joined_}.difference(self.known)
        if apart:
            self.learn_apart(list(apart))
        if letters:
            self.learn_letters(letters)
        if joined_:
            marks = {m: self.known[m] for m in {c[-1:] for c, _ in joined_}}
            pair = np.array([k for c, s in joined_ for k in (self.known[s], marks[c[-1:]])], np.int64)
            ids, size = self.ids_of(pair)
            self.add([c for c, _ in joined_], ids, size.reshape(-1, 2).sum(1))

    def encode_whole(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        return np.array(list(chain.from_iterable((*x, end) for x in ids)), np.uint32), np.array([len(x) + 1 for x in ids])

    def encode_long(self, text: str, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` of one text, a piece between white space at a time."""
        raw = text.encode("utf-8", "surrogatepass")
        at = [e for _, e in cuts(raw.translate(SPACES) + b" ")]
        got = [self.encode([raw[a:e].decode("utf-8", "surrogatepass")], end)[0][:-1] for a, e in zip([0, *at], at, strict=False)]
        ids = np.concatenate([*got, np.full(1, end, np.uint32)])
        return ids, np.array([len(ids)])

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with ``end`` after it, and the number of each text's ids."""
        if not self.whole_words:
            return self.encode_whole(texts, end)
        raw = [plain(t) for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        words = Chunks(b" ".join(raw) + b" ")
        found = self.table.find(words)
        if (found < 0).any():
            missing = np.flatnonzero(found < 0).tolist()
            chunks = [words[k] for k in missing]
            found[missing] = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
            new = {c for c, k in zip(chunks, found[missing].tolist(), strict=True) if k < 0}
            if FRESH * len(new) > len(found):
                return self.encode_whole(texts, end)  # most words are met but once: there is nothing to remember
            if len(self.known) + len(new) > MEMORY and self.known:
                self.thin()
                chunks = [words[k] for k in range(len(found))]
                missing, new = range(len(found)), set(chunks).difference(self.known)
            if new:
                self.learn(list(new))
                found[missing] = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        n = np.diff(np.searchsorted(words.start, np.r_[0, ends])) + 1
        inside = np.ones(n.sum(), bool)
        inside[np.cumsum(n) - 1] = False  # chunk 0 is the end of a text
        at = np.zeros(len(inside), np.int64)
        at[inside] = found
        out, size = self.ids_of(at)
        met = np.bincount(at, minlength=len(self.known) + 1)
        met[: len(self.seen)] += self.seen
        self.seen = met
        per = np.add.reduceat(size, np.cumsum(n) - n)
        out[np.cumsum(per) - 1] = end
        return out, per


@cache
def encoder(path: str, whole_words: bool | None) -> ChunkEncoder:
    """One encoder per worker process; it keeps its memory from task to task. A task has one core, so no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, whole_words)



def write_tokens(documents: DataFrame, path: str, tokenizer: str, vocabulary: int | None = None, end: int = 2, whole_words: bool | None = None, partitions: int | None = None) -> None:
    """Encode ``documents`` (doc_id, text) and write them below ``path`` in ascending doc_id order, nulls first.

    The text is dealt by ranges of doc_id, encoded and packed where it arrives. Files are named in order. Repeated ids
    stay next to each other, ordered by text; repeated rows are each written. Null text is empty: its only id is
    ``end``, as for an empty text. A very long text is encoded in pieces between white space if the tokenizer allows
    that, and is one document in one file. An empty table gives no documents. Other columns are not looked at.
    Without ``vocabulary`` an id takes the bits of the tokenizer's largest; an id that needs more is an error.
    """
    if vocabulary is None:
        vocabulary = 1 + max(end, *encoder(tokenizer, whole_words).tokenizer.get_vocab().values())
    if partitions is None:
        partitions = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, int(vocabulary - 1).bit_length())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, whole_words)
        docs, sizes, ids, n = [], [], [], 0

        def file() -> pa.RecordBatch:
            data = encode_file(docs, np.concatenate(sizes), np.concatenate(ids), width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for part in by_bytes(batches, 1, 256):
            texts = part.column(1).to_pylist()
            long = own.whole_words and len(texts) == 1 and len(texts[0] or "") > BLOCK
            got, per = own.encode_long(texts[0], end) if long else own.encode(texts, end)
            docs += part.column(0).to_pylist()
            sizes.append(per)
            ids.append(got)
            n += len(got)
            if n >= FILE_IDS:
                yield file()
                docs, sizes, ids, n = [], [], [], 0
        if docs:
            yield file()

    ordered = documents.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    # the text writer puts down the bytes of a string as they are, and a line feed after each row
    files = ordered.mapInArrow(tidy(encode), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_tokens(scratch: Scratch, spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Without any document the result is empty; a document is as the files have it, repeated ones and nulls too.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(data.as_py())
                ids = f.ids(0, f.n_ids).astype("<u4").tobytes()
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(f.doc_ids, pa.int64()), pa.array(starts), pa.array(f.lengths), pa.array(crc, pa.int64())], ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # a file's name has its partition's number and its own
    number = lambda pattern: F.lpad(F.regexp_extract("path", pattern, 1), 10, "0")
    order = F.concat(number(r"part-(\d+)"), F.lit("-"), number(r"-c(\d+)"))
    raw = spark.read.format("binaryFile").load(path).select(order.alias("file"), "content")
    docs = scratch.save(raw.mapInArrow(tidy(decode), "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"), "decoded")
    # one row per file; their running total is two-level, so no task sees more files than a partition has
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.substring_index("file", "-", 1))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = parts.select("part", before.alias("part_start"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n")
    starts = files.select("file", "part", inner.alias("file_start")).join(parts, "part").select("file", (F.col("part_start") + F.col("file_start")).alias("file_start"))
    return lookup(docs, scratch.save(starts, "starts"), ["file"]).select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
