"""A content-addressed store of token ids.

Every text is encoded, the end id appended, and the id stream of the document cut where a rolling
hash of the last ``WINDOW`` ids matches a mask, so equal passages give equal chunks wherever they
stand. A chunk's key is a digest of its bytes. The store is a folder of Parquet tables:

* ``chunks``: key, n_ids, payload (little-endian ids, two bytes each if the vocabulary allows, else
  four); each key once.
* ``recipes``: start, doc_id, n_tokens, keys (the chunks in order), root (digest over the keys),
  index; in ascending (doc_id, root) order, ``start`` being the ids of all documents before.
* ``manifest``: the Merkle tree over the roots: level, node, digest; each node hashes at most
  ``FAN_OUT`` children. The highest level has one row.

Reading checks all of it: the Merkle tree of the recipes read back against the stored manifest, every
document's keys against its root, every payload against its key. A mismatch, a lost recipe or a
missing chunk raises.

Encoding. Where the tokenizer's file has the normalizer and the split of ``PIECEWISE``, white space
never reaches a token, so texts are split at ASCII white space, a block at a time, and the ids of its
distinct pieces come from bounded tables of what is already encoded; only new words go to the library,
and pieces with characters beyond Latin go there whole. Texts for any other tokenizer go
to the library whole.

Cases. Null text: as empty, so only the end id. Very long texts: whole, a chunk holds at most ``MOST``
ids. Repeated rows or ids: a recipe each, next to one another. Null doc_id: ordered last. Empty table:
an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, blocks_of, claim, prefix_sums, release_shuffles

WINDOW = 16
LEAST, MOST, MASK_BITS = 64, 2048, 9
FAN_OUT = 1024
KNOWN_PIECES, KNOWN_WORDS = 600_000, 300_000
END_ID = 1


def chunk_key(payload: bytes) -> bytes:
    return blake2b(payload, digest_size=16).digest()


def recipe_root(keys: list[bytes]) -> bytes:
    return blake2b(b"".join(keys), digest_size=16, person=b"recipe").digest()


# The letters and numbers among the first 256 code points, as Unicode classes them
LETTERS, NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")  # of text without white space
LATIN = re.compile("[\x21-\x7e\xa1-\xff]+")
# The normalizer and the split, as tokenizer files write them, that let texts be encoded piece by piece
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def last_id(tokenizer_json: str) -> int:
    """The largest id that the file gives."""
    own = json.loads(tokenizer_json)
    vocab = own["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max([*ids, *(t["id"] for t in own.get("added_tokens") or [])], default=0)


def works_piecewise(tokenizer_json: str) -> bool:
    """Whether the file splits as ``PIECEWISE`` does and its added tokens can be told by ``<|``."""
    own = json.loads(tokenizer_json)
    marked = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in own.get("added_tokens") or [])
    return marked and all(own.get(k) == v for k, v in PIECEWISE.items())


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself if printable, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Encoder:
    """Texts to ids through bounded tables of white-space pieces and of words already encoded.

    A new piece of plain Latin characters is lower-cased and split into words here, and each new word
    goes to the library's model; any other piece goes to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.wide = last_id(tokenizer_json) >= 1 << 16
        self.dtype, self.code = ("<u4", "I") if self.wide else ("<u2", "H")  # machines of Spark are little-endian
        self.piecewise = works_piecewise(tokenizer_json)
        self.pieces = Pieces(self)
        self.words: dict[str, bytes] = {}
        self.alphabet = dict(enumerate(byte_alphabet()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a lower-cased word."""
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.words) < KNOWN_WORDS:
                self.words[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        low = piece.lower()
        if not piece:  # a text begins or ends with white space
            return b""
        if piece.isascii():
            if low.isalpha():
                return self.word(low)
            if low[-1] in ".," and low[:-1].isalpha():
                return self.word(low[:-1]) + self.word(low[-1])
        elif not LATIN.fullmatch(piece):
            return self._whole(piece)
        if "<|" in piece:
            return self._whole(piece)
        return b"".join([self.word(w) for w in WORDS.findall(low)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = texts.fill_null("")
        if not self.piecewise:
            own = [self._whole(t) for t in texts.to_pylist()]
            ids = np.frombuffer(b"".join(own), self.dtype)
            return ids, np.array([len(x) for x in own], np.int64) // ids.itemsize
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()  # each piece of a block is looked up once
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        held = list(map(self.pieces.__getitem__, distinct.split(" ") if len(coded.dictionary) else []))
        blob = np.frombuffer(b"".join(held), self.dtype)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // blob.itemsize
        starts = np.cumsum(sizes) - sizes
        which, parts, ends = np.asarray(coded.indices), [], [np.zeros(1, np.int64)]
        for at in range(0, len(which), 1 << 18):
            own = which[at : at + (1 << 18)]
            n = sizes[own]
            before = np.cumsum(n)
            parts.append(blob[np.repeat(starts[own] - before + n, n) + np.arange(before[-1])])
            ends.append(before + ends[-1][-1])
        ends = np.concatenate(ends)[np.asarray(split.offsets)]
        return np.concatenate(parts) if parts else blob[:0], np.diff(ends)


class Pieces(dict):
    """Pieces to their ids; a missing one is encoded, and kept while there is room."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece)
        if len(self) < KNOWN_PIECES:
            self[piece] = ids
        return ids


_encoders: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    """The worker's encoder; its tables serve all tasks that run there."""
    claim("tokens", _encoders.clear)
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _gear() -> np.ndarray:
    """A random 64-bit number for each id, from a fixed rule."""
    from .common import mix64

    return mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cut_points(ids: np.ndarray, lengths: list[int], gear: np.ndarray) -> list[list[int]]:
    """For documents laid end to end: the ends of each one's chunks, from its own start."""
    value = gear[ids & 0xFFFF] if len(ids) else np.zeros(0, np.uint64)
    rolled, width = value, 1
    while width < WINDOW:  # sums over the last 2, 4, 8, 16 ids, each id shifted by its distance
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint64(width)
        rolled, width = wider, 2 * width
    # the window never reaches another document: no chunk ends before LEAST > WINDOW ids
    marks = np.flatnonzero((rolled >> np.uint64(WINDOW)) & np.uint64((1 << MASK_BITS) - 1) == 0).tolist()
    out, at, m = [], 0, 0
    for n in lengths:
        ends, last, stop = [], 0, at + n
        while m < len(marks) and marks[m] < stop:
            end = marks[m] + 1 - at
            m += 1
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
        at = stop
    return out


STAGED = "kind string, doc_id long, n_tokens long, keys array<binary>, root binary, payload binary"
_STAGED_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.binary())), ("root", pa.binary()), ("payload", pa.binary())])


def _encode_partition(tokenizer, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, gear, seen = encoder_of(tokenizer.value), _gear(), set()
        width = 4 if encoder.wide else 2
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for at, to in blocks_of(size, 1 << 22):
                part = batch.slice(at, to - at)
                docs = part.column(0).to_pylist()
                stream, lengths = encoder.encode(part.column(1))
                stream = np.insert(stream, np.cumsum(lengths), end_id)
                lengths = (lengths + 1).tolist()
                cuts = cut_points(stream, lengths, gear)
                whole, first = stream.tobytes(), 0
                kinds, ids, counts, keys, roots, payloads = [], [], [], [], [], []
                for doc, n, ends in zip(docs, lengths, cuts, strict=True):
                    own, begin = [], 0
                    for e in ends:
                        payload = whole[(first + begin) * width : (first + e) * width]
                        own.append(k := chunk_key(payload))
                        begin = e
                        if k not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(k)
                            kinds.append("chunk"), ids.append(None), counts.append(len(payload) // width), keys.append([k]), roots.append(None), payloads.append(payload)
                    first += n
                    kinds.append("recipe"), ids.append(doc), counts.append(n), keys.append(own), roots.append(recipe_root(own)), payloads.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((kinds, ids, counts, keys, roots, payloads), _STAGED_ARROW, strict=True)], schema=_STAGED_ARROW)

    return run


class TokenStore:
    """A written store; ``root`` is its folder."""

    def __init__(self, tables: SharedTables, wide: bool):
        self.tables, self.root, self.wide = tables, tables.root, wide
        read = tables.spark.read.parquet
        self.chunks, self.recipes, self.manifest = (read(tables.path(x)) for x in ("chunks", "recipes", "manifest"))

    def read_back(self) -> DataFrame:
        """start, doc_id, n_tokens, root, parts (pos, key, payload): recipes that the manifest vouches for, with their chunks."""
        if not self.manifest_holds():
            raise ValueError("the recipes do not match the manifest")
        wanted = self.recipes.select("start", F.posexplode("keys").alias("pos", "key"))
        pieces = wanted.join(self.chunks.select("key", "payload"), "key", "left")
        rows = pieces.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "payload"))).alias("parts"))
        return self.recipes.select("start", "doc_id", "n_tokens", "root").join(rows, "start")

    def digests(self) -> DataFrame:
        """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
        width = 4 if self.wide else 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                start, doc, n, root, parts = (b.column(i) for i in range(5))
                crcs = []
                for want_n, want_root, own in zip(n.to_pylist(), root.to_pylist(), parts.to_pylist(), strict=True):
                    ids = b"".join([check_chunk(p["key"], p["payload"]) for p in own])
                    if recipe_root([p["key"] for p in own]) != want_root or len(ids) != want_n * width:
                        raise ValueError("a document's chunks do not match its recipe")
                    crcs.append(zlib.crc32(np.frombuffer(ids, "<u4" if width == 4 else "<u2").astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([doc, start, n, pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.read_back().mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def manifest_holds(self) -> bool:
        """Whether the stored Merkle tree is the one of the stored recipes."""
        top = merkle_levels(self.recipes)[-1].collect()  # one node, or none
        stored = self.manifest.orderBy(F.desc("level"), "node").limit(1).collect()
        return [tuple(r) for r in top] == [tuple(r) for r in stored]


def check_chunk(key: bytes, payload: bytes | None) -> bytes:
    if payload is None or chunk_key(payload) != key:
        raise ValueError(f"chunk {key.hex()} is missing or damaged")
    return payload


def merkle_level(nodes: DataFrame) -> DataFrame:
    """(level, node, digest) to the level above: at most FAN_OUT children a node."""
    up = nodes.groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"), F.max("level").alias("level"))
    return up.select((F.col("level") + 1).cast("int").alias("level"), "node", F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))


def merkle_levels(recipes: DataFrame) -> list[DataFrame]:
    """All levels, lowest first; as many as the number of documents needs."""
    level = recipes.select(F.lit(0).alias("level"), F.col("index").alias("node"), F.hex("root").alias("digest"))
    n, out = recipes.count(), []
    while not out or n > 1:
        level, n = merkle_level(level), -(-n // FAN_OUT)
        out.append(level)
    return out


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tables: SharedTables | None = None) -> TokenStore:
    """Encode every whole text and write the store; returns a handle to it."""
    spark = docs.sparkSession
    tables = tables or SharedTables(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's file; executors get its content
        text = f.read()
    wide = last_id(text) >= 1 << 16
    shared = spark.sparkContext.broadcast(text)  # a vocabulary: a few MB whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = tables.write(rows.mapInArrow(_encode_partition(shared, end_id), STAGED), "staged", "zstd", ["kind"])
    chunks = staged.where("kind = 'chunk'").select(F.element_at("keys", 1).alias("key"), F.col("n_tokens").alias("n_ids"), "payload")
    tables.write(chunks.groupBy("key").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload")), "chunks", "zstd")
    recipes = staged.where("kind = 'recipe'").select("doc_id", "n_tokens", "keys", "root", F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(tables, recipes, ["doc_id", "root"], {"start": "n_tokens", "index": "one"})
    tables.write(placed.select("start", "doc_id", "n_tokens", "keys", "root", "index"), "recipes")
    for name in ("staged", "ranged"):
        tables.drop(name)
    release_shuffles(spark)
    written = spark.read.parquet(tables.path("recipes"))
    levels = merkle_levels(written)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    tables.write(nodes, "manifest")
    return TokenStore(tables, wide)
