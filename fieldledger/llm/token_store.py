"""Token ids on disk: each document compressed by itself against one shared zstandard dictionary.

Format. A store is a folder with two Parquet tables, so it lives wherever Spark can write:

* ``dictionary``: one row, ``dict_hash`` (SHA-256, lowercase hex) and ``dictionary`` (bytes, empty if none was trained).
* ``packs``: one row per pack of consecutive documents: ``bucket`` and ``pack`` (their order is the document
  order), ``first_doc`` and ``last_doc``, ``dict_hash``, ``n_tokens``, ``doc_ids`` (array), ``lengths`` (ids of
  each document, end id included), ``offsets`` (where each frame starts in ``data``, one more at the end),
  ``starts`` (ids of the pack before each document) and ``data`` (zstandard frames of little-endian unsigned 32-bit ids).

A reader of one document takes the pack whose range holds it, one slice of ``data`` and the dictionary.

Cases: a null text is an empty one (only the end id); null doc_ids come first; rows that repeat a doc_id stay
apart, ordered by the hash of their text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import partitions, record_batch, slices, text_buffers

# Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_DOCUMENTS = 1000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 64 << 10
# A pack is closed at so many ids or documents.
PACK_IDS = 1 << 19
PACK_DOCUMENTS = 4096
END_ID = 0
# Bytes of text that are encoded at once, unless a single text is longer; equal pieces in them are looked up once.
ENCODED_BYTES = 4 << 20
# Bounds of the per-worker cache of encoded pieces: entries, and ids of all of them.
CACHED_WORDS = 400_000
CACHED_IDS = 8 << 20
# Parts that the library gets at once.
PARTS = 1000

# The split pattern of this byte-level vocabulary. Pieces are split joined by a character that stands for
# the end of a text: no UTF-8 has its byte.
_END, _END_BYTE = "\udcff", 0xFF
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}{_END}]+|\s+(?![^\s{_END}])|\s+"
# From this byte on a character may be beyond Latin Extended-B.
_FAR = 0xC9


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_SPACE = _bytes((0x09, 0x0D), (0x20, 0x20))
_LETTER = _bytes((0x41, 0x5A), (0x61, 0x7A))
_MARK = _bytes((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
# What may be white space to one library and not to another counts as such.
_NOT_VISIBLE = _SPACE | _bytes((0x1C, 0x1F))
# The first bytes of white space of three bytes, and the second ones of C3 that are no letters.
_WIDE, _SIGN = _bytes((0xE1, 0xE3)), _bytes((0x97, 0x97), (0xB7, 0xB7))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if printable in Latin-1, else the
    next free one from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of some texts start: at each text, at ASCII white space after a visible character, and at an
    ASCII mark (but ') after a letter of Latin-1.

    No part of the split pattern goes on there, and none looks back, so a piece is split alike wherever it stands.
    White space beyond ASCII starts with a byte C2, E1, E2 or E3."""
    at = np.flatnonzero((_SPACE | _MARK)[data])
    at = at[at > 0]
    before, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    ends_visible = ~_NOT_VISIBLE[before] & (second != 0xC2) & ~_WIDE[third]
    ends_letter = _LETTER[before] | ((second == 0xC3) & ~_SIGN[before])
    first = np.zeros(len(data) + 1, bool)
    first[at[np.where(_SPACE[data[at]], ends_visible, ends_letter)]] = True
    first[offsets] = True
    return np.flatnonzero(first[:-1])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


class _Words:
    """Encodes the distinct pieces of many texts through the library, and remembers them for the next texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark runs a worker per core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT).findall
        # The same model, for parts that are written in the letters of the vocabulary, none of which is white space.
        self.parts = Tokenizer(self.whole.model)
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.letters = np.array([ord("\n") if b == _END_BYTE else ord(letters[b]) for b in range(256)], "<u4")
        vocabulary = self.whole.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self._keep(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _keep(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers pieces, how many ids each has, and their ids one after another."""
        self.pieces, self.sizes, self.known_ids = pieces, sizes, ids
        self.met = np.zeros(len(pieces), bool)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _near(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without characters beyond Latin Extended-B: split here, parts through the model."""
        joined = np.insert(data, offsets[1:-1], _END_BYTE).tobytes().decode(errors="surrogateescape")
        found = []
        for parts in itertools.batched(self.split(joined), PARTS):
            raw = _END.join(parts).encode(errors="surrogateescape")
            text = self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
            found.append(np.array(self.parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        # Every byte is in one id, so the bytes of the ids tell where a piece ends.
        ends = np.append(0, np.cumsum(self.lengths[ids]))
        border = np.searchsorted(ends, offsets)
        if not np.array_equal(ends[np.minimum(border, len(ids))], offsets):
            raise ValueError("the ids of a text do not spell it")
        return np.diff(border), ids

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encodes and remembers pieces; returns their numbers. Those with characters beyond Latin Extended-B go through
        the whole tokenizer, so that the character classes are the library's own."""
        data, offsets = text_buffers(new)
        far = np.zeros(len(new), bool)
        far[np.searchsorted(offsets, np.flatnonzero(data >= _FAR), "right") - 1] = True
        order = np.argsort(far, kind="stable")
        new = new.take(pa.array(order))
        near = len(new) - int(far.sum())
        sizes, ids = self._near(*text_buffers(new.slice(0, near)))
        more = self._whole([p.decode() for p in new.slice(near).to_pylist()])
        number = np.empty(len(new), np.int64)
        number[order] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.sizes = np.concatenate([self.sizes, sizes, np.array(list(map(len, more)), np.int64)])
        self.known_ids = np.concatenate([self.known_ids, ids, *(np.array(m, "<u4") for m in more)])
        self.met = np.append(self.met, np.zeros(len(new), bool))
        return number

    def _forget(self) -> None:
        """Beyond a bound, what was not met again leaves; everything, if that is too little."""
        if len(self.pieces) <= CACHED_WORDS and len(self.known_ids) <= CACHED_IDS:
            return
        met, kept = self.met, np.repeat(self.met, self.sizes)
        if 2 * met.sum() > CACHED_WORDS or 2 * kept.sum() > CACHED_IDS:
            met, kept = np.zeros_like(met), np.zeros_like(kept)
        self._keep(self.pieces.filter(pa.array(met)), self.sizes[met], self.known_ids[kept])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers; a null counts as an empty text."""
        data, offsets = text_buffers(texts)
        starts = piece_starts(data, offsets)
        coded = _binary(data, np.append(starts, len(data))).dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=self.pieces)
        fresh = number.is_null().to_numpy(zero_copy_only=False)
        number = number.fill_null(0).to_numpy().astype(np.int64)
        self.met[number[~fresh]] = True
        if fresh.any():
            number[fresh] = self._learn(coded.dictionary.filter(pa.array(fresh)))
        number = number[coded.indices.to_numpy()]
        counts = self.sizes[number]
        ends = np.append(0, np.cumsum(counts))
        # The ids of a piece stand together; those of all pieces in turn are taken from there.
        shift = (np.cumsum(self.sizes) - self.sizes)[number] - ends[:-1]
        ids = self.known_ids[np.repeat(shift, counts) + np.arange(ends[-1])].tobytes()
        border = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        out = [ids[a:b] for a, b in itertools.pairwise(border)]
        self._forget()
        # Added tokens are cut out before words are split, and may take the space beside them.
        for added in self.added:
            has = pc.fill_null(pc.match_substring(texts, added), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(has).tolist():
                out[i] = np.array(self._whole([texts[i].as_py()])[0], "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0]


@cache
def encoder(path: str) -> _Words:
    return _Words(path)


def _dictionary(blob: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(blob) if blob else None


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the serialized arrays; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sample_ids(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text", ENCODED_BYTES):
            yield record_batch(schema, encoder(path).encode(part.column("text")))


_PACKS = (
    "bucket int, pack int, first_doc bigint, last_doc bigint, dict_hash string, n_tokens bigint, "
    "doc_ids array<bigint>, lengths array<int>, offsets array<bigint>, starts array<bigint>, data binary"
)
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("pack", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]
    + [("dict_hash", pa.string()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [("lengths", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
    + [("data", pa.binary())]
)


def _encoded(batch: pa.RecordBatch, words: _Words) -> Iterator[tuple[int, int | None, bytes]]:
    for part in slices(batch, "text", ENCODED_BYTES):
        columns = (part.column(c).to_pylist() for c in ("bucket", "doc_id"))
        yield from zip(*columns, words.encode(part.column("text")), strict=True)


def _pack(batches: Iterable[pa.RecordBatch], path: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and document become packs; a pack holds documents of one bucket."""
    words = encoder(path)
    digest = hashlib.sha256(dictionary).hexdigest()
    packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
    end = np.array([END_ID], "<u4").tobytes()
    bucket, number, docs, lengths, frames = None, 0, [], [], []

    def closed() -> pa.RecordBatch:
        known = [d for d in docs if d is not None]
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.int64)))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        row = [bucket, number, min(known, default=None), max(known, default=None), digest, sum(lengths)]
        return record_batch(_ARROW, *([x] for x in row), [docs], [lengths], [offsets], [starts], [b"".join(frames)])

    total = 0
    for batch in batches:
        for at, doc, ids in _encoded(batch, words):
            if docs and (at != bucket or total >= PACK_IDS or len(docs) >= PACK_DOCUMENTS):
                yield closed()
                number = number + 1 if at == bucket else 0
                docs, lengths, frames, total = [], [], [], 0
            bucket = at
            ids += end
            docs.append(doc)
            lengths.append(len(ids) // 4)
            frames.append(packer.compress(ids))
            total += len(ids) // 4
    if docs:
        yield closed()


def _ordered(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt to ``parts`` buckets of ascending ids. The borders are quantiles of all ids (to within
    1/1000 of a bucket's place); an id that is a border itself is dealt over the buckets it borders on."""
    low = F.lit(-(1 << 63)).cast("long")
    docs = docs.select(F.coalesce("doc_id", low).alias("key"), "doc_id", "text")
    borders = docs.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    if not borders:
        return docs.withColumn("bucket", F.lit(0)).withColumn("tie", F.xxhash64("text"))
    # approxQuantile works in doubles; whole numbers near them are borders as good.
    edges = F.array(*[F.lit(max(-(1 << 63), min(int(b), (1 << 63) - 1))).cast("long") for b in borders])
    below = F.size(F.filter(edges, lambda e: e < F.col("key")))
    upto = F.size(F.filter(edges, lambda e: e <= F.col("key")))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    return docs.withColumn("bucket", (below + F.pmod(F.col("tie"), upto - below + 1)).cast("int"))


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes every document with the tokenizer file ``tokenizer`` and writes a store to ``path``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    every = max(1, docs.count() // SAMPLE_DOCUMENTS)
    short = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & (F.length("text") <= SAMPLE_CHARS))
    sample = short.select("text").limit(2 * SAMPLE_DOCUMENTS)
    samples = [bytes(r.ids) for r in sample.mapInArrow(partial(_sample_ids, path=tokenizer), "ids binary").collect()]
    dictionary = train_dictionary(samples)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(
        f"{path}/dictionary"
    )
    parts = max(1, partitions(spark))
    rows = _ordered(docs, parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "tie")
    packs = rows.select("bucket", "doc_id", "text").mapInArrow(
        partial(_pack, path=tokenizer, dictionary=dictionary), _PACKS
    )
    packs.write.parquet(f"{path}/packs")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary of a store; fails if its bytes do not have the hash that is kept with it."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    return bytes(row.dictionary)


def _frames(batches: Iterable[pa.RecordBatch], dictionary: bytes, digest: bool, wanted: frozenset[int] | None):
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    known = hashlib.sha256(dictionary).hexdigest()
    tail = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), tail])
    for batch in batches:
        for pack in batch.to_pylist():
            if pack["dict_hash"] != known:
                raise ValueError("a pack was compressed with another dictionary")
            rows: list[tuple] = []
            data = memoryview(pack["data"])
            for i, doc in enumerate(pack["doc_ids"]):
                if wanted is not None and doc not in wanted:
                    continue
                raw = opener.decompress(data[pack["offsets"][i] : pack["offsets"][i + 1]])
                value = zlib.crc32(raw) if digest else np.frombuffer(raw, "<u4").astype(np.int64)
                rows.append((doc, pack["before"] + pack["starts"][i], len(raw) // 4, value))
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))


def _read(spark: SparkSession, path: str, digest: bool, wanted: Iterable[int] | None = None) -> DataFrame:
    packs = spark.read.parquet(f"{path}/packs")
    place = packs.select("bucket", "pack", "n_tokens")
    # Ids before each bucket: one row per bucket; before each pack: within its bucket.
    buckets = place.groupBy("bucket").agg(F.sum("n_tokens").alias("ids"))
    ahead = buckets.select("bucket", (F.sum("ids").over(Window.orderBy("bucket")) - F.col("ids")).alias("ahead"))
    inner = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("pack")) - F.col("n_tokens")
    before = place.withColumn("inner", inner).join(ahead, "bucket").select(
        "bucket", "pack", (F.col("ahead") + F.col("inner")).alias("before")
    )
    chosen = None
    if wanted is not None:
        chosen = frozenset(wanted)
        low, high = min(chosen, default=0), max(chosen, default=-1)
        packs = packs.where((F.col("last_doc") >= low) & (F.col("first_doc") <= high))
    tail = "ids_crc32 bigint" if digest else "ids array<bigint>"
    return packs.join(before, ["bucket", "pack"]).mapInArrow(
        partial(_frames, dictionary=read_dictionary(spark, path), digest=digest, wanted=chosen),
        f"doc_id bigint, start bigint, n_tokens bigint, {tail}",
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document."""
    return _read(spark, path, digest=False)


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of a few documents: packs are skipped by their range, other frames are not opened."""
    return _read(spark, path, digest=False, wanted=doc_ids)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_store` with the unsigned CRC-32 of the id bytes instead of the ids."""
    return _read(spark, path, digest=True)
