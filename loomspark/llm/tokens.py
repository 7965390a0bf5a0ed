"""Token ids as directly addressable codes (DAC): a file format with random access to any token.

An id is cut into 8-bit chunks. Level 0 holds the low chunk of every id, level k the next chunk of those ids that
have one; a continuation bitmap per level says which, and a rank directory (ones before every 512 bits) turns a
position at one level into its position at the next. So token i of a file costs at most four lookups and no block
is decoded.

File: ``DAC1``, u32 header length, JSON header, then the sections it lists. Files cover ascending, disjoint ranges
of doc_id, documents in ascending doc_id inside, so file after file the ids are in ascending doc_id order.

Nulls: a null text is empty (only the end id), a null doc_id sorts before all others. Rows that repeat a doc_id are
kept all, ordered by their ids. Empty tables give no files and no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, materialize, shared_dir, tidy
from .files import read_bytes, write_bytes

BLOCK = 512  # bits of a bitmap per entry of its rank directory
PART_MB = 6  # of input per file, at least; MAX_PARTS bounds the number of files
MAX_PARTS = 50_000
CACHE_WORDS = 600_000  # some 250 bytes each, in every worker
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- the format


def dac_encode(ids: np.ndarray) -> list[dict]:
    """Levels of {chunks, bitmap, rank} for unsigned ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK)).astype(np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])
        levels.append({"chunks": (rest & 255).astype(np.uint8), "bitmap": bits, "rank": rank.astype("<u8")})
        if not more.any():
            return levels
        rest = rest[more] >> 8


def dac_bytes(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file."""
    parts = [doc_ids.astype("<i8").tobytes(), offsets.astype("<u8").tobytes()]
    for lv in dac_encode(ids):
        parts += [lv["chunks"].tobytes(), lv["bitmap"].tobytes(), lv["rank"].tobytes()]
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "sizes": [len(p) for p in parts], "crc": [zlib.crc32(p) for p in parts]}).encode()
    return b"DAC1" + struct.pack("<I", len(head)) + head + b"".join(parts)


class DacFile:
    """Random access to the ids of a file."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC file")
        n = struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(data[8 : 8 + n])
        at, sections = 8 + n, []
        for size, crc in zip(self.head["sizes"], self.head["crc"], strict=True):
            piece = data[at : at + size]
            if len(piece) != size or zlib.crc32(piece) != crc:
                raise ValueError("the file is damaged")
            sections.append(piece)
            at += size
        self.doc_ids = np.frombuffer(sections[0], "<i8")
        self.offsets = np.frombuffer(sections[1], "<u8").astype(np.int64)
        self.levels = [tuple(np.frombuffer(x, t) for x, t in zip(sections[i : i + 3], ("u1", "u1", "<u8"), strict=True)) for i in range(2, len(sections), 3)]

    def __len__(self) -> int:
        return self.head["tokens"]

    def get(self, i: int) -> int:
        """Token i, by one bitmap test and one rank per level."""
        out = 0
        for k, (chunks, bitmap, rank) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return out
            block = i // BLOCK
            lo = block * BLOCK // 8
            ones = int(np.bitwise_count(bitmap[lo : i >> 3]).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(rank[block]) + ones
        raise ValueError("a continuation bit on the last level")

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


# ---------------------------------------------------------------- encoding texts

_encoders: dict[str, Encoder] = {}
# Pieces of a text that encode independently: white space only separates, and a run of plain small letters that only
# signs follow up to the next blank is a pre-token, as those signs are. Anything else stays whole up to the next blank.
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+(?=[,.;:!?%$&*#|]*(?:[ \n\t\r]|$))|[^ \n\t\r]+")
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Encoder:
    """Ids of texts by a tokenizer whose pre-tokenizer never joins across blanks, with a cache of pieces.

    Texts are lower-cased first if the tokenizer lower-cases and the result is the same (normalised, no sigma, no
    ``<|`` that could begin a special token, which is matched before lower-casing). Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = json.dumps(spec.get("normalizer") or {}), json.dumps(spec.get("pre_tokenizer") or {})
        self.lower = "Lowercase" in normal
        self.pieces = '"\\\\s+"' in normal and "Removed" in pre and "\\\\p{L}" in pre
        suffix = spec.get("model", {}).get("end_of_word_suffix") or ""
        self.ends = None
        if suffix:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # ids are kept as 16-bit numbers if all fit
        self.wide = self.tok.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if self.lower and "<|" not in text and "\u03a3" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            text = text.lower()
        return _PIECES.findall(text)

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if _WORD.fullmatch(w)] if self.ends is not None else []
        plain = set(words)
        for i in range(0, len(words), 12_800):
            groups = [words[k : k + 128] for k in range(i, min(i + 12_800, len(words)), 128)]
            for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) != len(g):
                    plain.difference_update(g)
                    continue
                raw, at = ids.tobytes(), 0
                for w, z in zip(g, (stop * ids.itemsize).tolist(), strict=True):
                    self.young[w] = raw[at:z]
                    at = z
        rest = [w for w in new if w not in plain]
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.young[w] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.frombuffer(x, self.kind) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text as packed numbers, with ``end`` behind each."""
        if not self.pieces:
            return [np.array(e.ids, self.kind).tobytes() + end for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        cut = [self._cut(t) for t in texts]
        out, open_, need = [], [], {}
        get = self.young.get
        for k, ws in enumerate(cut):  # each piece is looked up once; only those not found are looked at again
            ids = list(map(get, ws))
            if None in ids:
                at = [i for i, v in enumerate(ids) if v is None]
                open_.append((k, at))
                need.update(dict.fromkeys([ws[i] for i in at]))
            out.append(ids)
        if need:
            if len(self.young) + len(need) > CACHE_WORDS // 2:
                self.old, self.young = self.young, {}
            new = []
            for w in need:
                if (v := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.young[w] = v
            self._learn(new)
            for k, at in open_:
                ids, ws = out[k], cut[k]
                for i in at:
                    ids[i] = self.young[ws[i]]
        return [b"".join(ids) + end for ids in out]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and path."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write_part(folder: str, part: int, table: pa.Table) -> pa.Table:
    """Write one file. Texts are encoded before any file is written, so the caches of a worker that encoded go first."""
    _encoders.clear()
    doc, wide, ids = (table.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))
    del table
    order = sorted(range(len(doc)), key=lambda i: (doc[i], ids[i]))
    arrays = [np.frombuffer(ids[i], "<u4" if wide[i] else "<u2") for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    every = np.concatenate(arrays)
    del ids, arrays
    path = f"{folder}/part-{part:09d}-{uuid.uuid4().hex}.dac"
    write_bytes(path, dac_bytes(np.array([doc[i] for i in order], np.int64), offsets, every))
    del every
    tidy()
    return pa.table({"part": [part], "path": [path], "n_docs": [len(doc)], "n_tokens": [int(offsets[-1])]})


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode every text and write DAC files; rows (part, path, n_docs, n_tokens) in ascending part = ascending doc_id.

    Range bounds come from a sketch of doc_id alone; only encoded ids are shuffled, as 16-bit numbers where they fit.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = min(MAX_PARTS, int(input_bytes(docs) / (PART_MB * 1e6)) + 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, np.int64)) if parts > 1 else np.zeros(0, np.int64)

    def encode(batches):
        enc = encoder(tokenizer)
        wide = enc.wide or end_id > 65535
        for b in batches:
            for lo in range(0, b.num_rows, 125):
                some = b.slice(lo, 125)
                ids = np.asarray(some.column(0))
                coded = enc.encode_bytes(some.column(1).to_pylist(), b"" if wide != enc.wide else np.array([end_id], enc.kind).tobytes())
                if wide != enc.wide:  # only the end id is too large
                    coded = [np.append(np.frombuffer(x, enc.kind).astype("<u4"), np.uint32(end_id)).tobytes() for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(cuts, ids, side="right").astype(np.int64)),
                        pa.array(ids),
                        pa.array([wide] * len(coded), pa.bool_()),
                        pa.array(coded, pa.binary()),
                    ],
                    ["part", "doc_id", "wide", "ids"],
                )
        tidy()

    coded = docs.mapInArrow(encode, "part long, doc_id long, wide boolean, ids binary")

    def write(key, table):
        return _write_part(folder, key[0].as_py(), table)

    return coded.groupBy("part").applyInArrow(write, "part long, path string, n_docs long, n_tokens long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    rows = manifest.select("part", "path", "n_tokens").orderBy("part").collect()  # one row a file, at most MAX_PARTS
    at, listed = 0, []
    for r in rows:
        listed.append((r["path"], at, r["n_tokens"]))
        at += r["n_tokens"]
    spark = manifest.sparkSession
    files = spark.createDataFrame(listed, "path string, at long, n_tokens long").repartition(max(1, len(listed))) if listed else spark.createDataFrame([], "path string, at long, n_tokens long")

    def read(batches):
        for b in batches:
            for path, first, want in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = DacFile(read_bytes(path))
                if len(f) != want:
                    raise ValueError(f"{path} holds {len(f)} ids, not {want}")
                ids = f.all().astype("<u4")
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(f.offsets[:-1], f.offsets[1:], strict=True)]
                doc = pa.array(f.doc_ids, mask=f.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([doc, pa.array(f.offsets[:-1] + first), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                del f, ids
                tidy()

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    manifest = materialize(write_tokens(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer, end_id), "token-manifest")
    return read_tokens(manifest)
