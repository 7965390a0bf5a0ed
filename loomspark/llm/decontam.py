"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents inside one task. Its words become symbols of the benchmark's vocabulary (0: any other
word, and the end of a document); runs of benchmark words too short for any window are left out, since no window
can occur there. Over what is left a suffix array gives the Burrows-Wheeler transform, a wavelet matrix gives ranks,
and all benchmark windows are searched backwards at once. Occurrences are located by sampled suffix positions,
compared with the text byte by byte, and merged to removal spans. Nothing is shuffled: the job is a scan.

The benchmark is compiled to block files of bounded size in the shared folder; workers hold one block at a time, so
a benchmark of any size is searched whole, in blocks.

Nulls: a null text has no words; an item with a null text has no windows; a null item_id counts as the id "null".
Items that repeat an id count once. Empty tables give empty results (empty benchmark: nothing is hit). Extra columns
are ignored by ``scan`` and kept by ``cut``.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_ALNUM, shared_dir, text_slices, tidy, word_hashes, words_of
from .files import read_bytes, write_bytes

WINDOW = 10
BLOCK_WORDS = 1_000_000  # benchmark words in one block file
SAMPLE = 16  # every so many suffix positions are kept
#: Words and bytes of a shard, beyond which no further slice of text is added. A worker holds some hundred bytes for each word.
SHARD_SYMBOLS = 300_000
SHARD_BYTES = 2_000_000
SLICE_BYTES = 500_000


# ---------------------------------------------------------------- the index


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros are all different, in order of position, so no comparison passes one."""
    n = len(s)
    rank = np.empty(n, np.int64)
    zero = s == 0
    nz = int(zero.sum())
    rank[zero] = np.arange(nz)
    rank[~zero] = s[~zero].astype(np.int64) + nz - 1
    h = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - h] += rank[h:] + 1 if h < n else 0
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(k[1:] != k[:-1], out=step[1:])
        new[order] = step
        rank = new
        if step[-1] == n - 1:
            return order
        h *= 2


class FMIndex:
    """Backward search and location over symbols 0..top (0 never matches)."""

    def __init__(self, s: np.ndarray, top: int):
        if not len(s) or s[-1]:
            s = np.append(s, np.int32(0))  # an end that no symbol is before
        self.n, self.s = len(s), s
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.bwt[sa == 0] = 0
        self.bits = max(1, int(top).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])  # rows before each symbol
        self.ranks, self.zeros, x = [], [], self.bwt
        for shift in range(self.bits - 1, -1, -1):  # wavelet matrix: ones before each position, level by level
            bit = (x >> shift) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.base = self._map(np.arange(top + 1), np.zeros(top + 1, np.int64))
        # sampled positions: every SAMPLE-th, and all that follow a zero, so location never steps over one
        keep = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.sampled = np.concatenate([[0], np.cumsum(keep)])
        self.positions = sa[keep]
        self.keep = keep

    def _map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level)) & 1
            r = ones[i]
            i = np.where(bit == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before row i."""
        return self._map(c, i) - self.base[c]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, first row, end row) of the patterns that occur; patterns are padded on the right."""
        which = np.flatnonzero(lengths > 0)
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        left = lengths[which].astype(np.int64)
        out = []
        while len(which):
            c = patterns[which, left - 1].astype(np.int64)
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            left = left - 1
            alive = lo < hi
            done = alive & (left == 0)
            if done.any():
                out.append((which[done], lo[done], hi[done]))
            go = alive & (left > 0)
            which, lo, hi, left = which[go], lo[go], hi[go], left[go]
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows, stepping back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        at = np.arange(len(rows))
        while len(at):
            hit = self.keep[rows]
            out[at[hit]] = self.positions[self.sampled[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            c = self.bwt[rows].astype(np.int64)
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


# ---------------------------------------------------------------- the benchmark


def item_words(text: str | None) -> list[bytes]:
    """The words of a text as the contract takes them."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]), WORD_ALNUM)
    raw = data.tobytes().lower()
    return [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]


def compile_block(items: list[tuple[str, list[bytes]]], window: int) -> bytes:
    """One block: vocabulary hashes, distinct windows as symbol rows, and which items have each window."""
    vocab = sorted({w for _, ws in items for w in ws})
    joined = np.frombuffer(b" ".join(vocab), np.uint8)
    starts, ends, _ = words_of(joined, np.array([0, len(joined)]), WORD_ALNUM)
    hashes = word_hashes(joined, starts, ends)
    unique = np.unique(hashes)
    symbol = dict(zip(vocab, (np.searchsorted(unique, hashes) + 1).tolist(), strict=True))
    windows: dict[tuple[bytes, ...], set[int]] = {}
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    for item, ws in items:
        size = min(window, len(ws))
        for a in range(len(ws) - size + 1 if size else 0):
            windows.setdefault(tuple(ws[a : a + size]), set()).add(number[item])
    rows = np.zeros((len(windows), window), np.int32)
    for k, w in enumerate(windows):
        rows[k, : len(w)] = [symbol[x] for x in w]
    owners = [sorted(x) for x in windows.values()]
    out = io.BytesIO()
    np.savez(
        out,
        hashes=unique,
        rows=rows,
        lengths=np.array([len(w) for w in windows], np.int32),
        owners=np.array([o for x in owners for o in x], np.int32),
        owner_at=np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64),
        ids=np.array(ids, dtype=np.str_) if ids else np.zeros(0, "U1"),
        words=np.frombuffer(b"\0".join(b" ".join(w) for w in windows), np.uint8),
    )
    return out.getvalue()


def compile_benchmark(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write the benchmark's block files; their paths. Items stream through the driver, one block in memory at a time."""
    folder = shared_dir(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    paths, block, n = [], [], 0

    def flush():
        path = f"{folder}/block-{len(paths)}-{uuid.uuid4().hex}.npz"
        write_bytes(path, compile_block(block, window))
        paths.append(path)

    for r in rows.toLocalIterator():
        ws = item_words(r["text"])
        block.append((r["item_id"], ws))
        n += len(ws)
        if n >= block_words:
            flush()
            block, n = [], 0
    if block:
        flush()
    return paths


class Block:
    """A block in a worker."""

    def __init__(self, path: str):
        z = np.load(io.BytesIO(read_bytes(path)))
        self.hashes, self.rows, self.lengths = z["hashes"], z["rows"], z["lengths"]
        self.owners, self.owner_at = z["owners"], z["owner_at"]
        self.ids = [str(x) for x in z["ids"]]
        self.words = z["words"].tobytes().split(b"\0") if len(self.lengths) else []
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        # a first sieve on 16 bits spares most binary searches
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each word hash; 0 for a word that the block lacks."""
        out = np.zeros(len(h), np.int32)
        if len(self.hashes):
            maybe = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[maybe])
            at[at == len(self.hashes)] = 0
            same = self.hashes[at] == h[maybe]
            out[maybe[same]] = at[same] + 1
        return out


_last: dict[str, Block] = {}


def load_block(path: str) -> Block:
    """The block last used stays in the worker."""
    if path not in _last:
        _last.clear()
        _last[path] = Block(path)
    return _last[path]


# ---------------------------------------------------------------- shards


class Shard:
    """Some documents of a task: words, and per block the occurrences of windows."""

    def __init__(self):
        self.ids, self.data, self.starts, self.ends, self.hashes, self.first = [], [], [], [], [], [0]
        self.n = 0

    def add(self, ids: list, data: np.ndarray, offs: np.ndarray) -> None:
        starts, ends, first = words_of(data, offs, WORD_ALNUM)
        base = sum(len(d) for d in self.data)
        self.hashes.append(word_hashes(data, starts, ends))
        self.starts.append(starts + base)
        self.ends.append(ends + base)
        self.data.append(data)
        self.ids += ids
        self.first += (first[1:] + self.n).tolist()
        self.n += len(starts)

    def scan(self, paths: list[str]) -> list[tuple]:
        """Per document: (id, words, hit words, item ids, byte spans inside the document)."""
        low = b"".join(d.tobytes().lower() for d in self.data)
        starts, ends = np.concatenate(self.starts), np.concatenate(self.ends)
        hashes, first = np.concatenate(self.hashes), np.array(self.first)
        edge = np.zeros(self.n + 1, np.int64)  # +1 where an occurrence begins, -1 where it ends
        items: list[set[str]] = [set() for _ in self.ids]
        for path in paths:
            b = load_block(path)
            if not b.shortest or not self.n:
                continue
            sym = b.symbols(hashes)
            # runs of benchmark words inside a document, long enough for the shortest window
            inside = sym > 0
            cut = np.zeros(self.n, bool)
            cut[first[:-1][first[:-1] < self.n]] = True
            run_start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut))
            run_end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | np.concatenate([cut[1:], [True]]))) + 1
            long = run_end - run_start >= b.shortest
            run_start, run_end = run_start[long], run_end[long]
            if not len(run_start):
                continue
            sizes = run_end - run_start
            at = np.concatenate([[0], np.cumsum(sizes + 1)])  # each run, then a zero
            place = np.full(at[-1], -1, np.int64)
            fill = np.ones(at[-1], bool)
            fill[at[1:] - 1] = False
            place[fill] = np.arange(sizes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.repeat(run_start, sizes)
            s = np.zeros(at[-1], np.int32)
            s[fill] = sym[place[fill]]
            index = FMIndex(s, len(b.hashes))
            which, lo, hi = index.search(b.rows, b.lengths)
            counts = hi - lo
            if not len(which):
                continue
            rows = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.repeat(lo, counts)
            word = place[index.locate(rows)]
            win = np.repeat(which, counts)
            size = b.lengths[win]
            doc = np.searchsorted(first, word, side="right") - 1
            ok = np.fromiter((self._same(low, starts, ends, w, k, b.words[p]) for w, k, p in zip(word.tolist(), size.tolist(), win.tolist(), strict=True)), bool, len(word))
            word, win, size, doc = word[ok], win[ok], size[ok], doc[ok]
            np.add.at(edge, word, 1)
            np.add.at(edge, word + size, -1)
            for d, p in np.unique(np.stack([doc, win], 1), axis=0).tolist():
                items[d].update(b.ids[o] for o in b.owners[b.owner_at[p] : b.owner_at[p + 1]])
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        at, out = 0, []
        lengths = self._doc_bytes()
        for d, doc_id in enumerate(self.ids):
            a, z = int(first[d]), int(first[d + 1])
            n = int(total[z] - total[a])
            spans = []
            if n:
                flags = np.concatenate([[0], hit[a:z].astype(np.int8), [0]])
                change = np.flatnonzero(np.diff(flags))
                spans = [(int(starts[a + x]) - at, int(ends[a + y - 1]) - at) for x, y in zip(change[::2], change[1::2], strict=True)]
            out.append((doc_id, z - a, n, sorted(items[d]), spans))
            at += lengths[d]
        return out

    @staticmethod
    def _same(low: bytes, starts: np.ndarray, ends: np.ndarray, w: int, k: int, want: bytes) -> bool:
        return b" ".join(low[a:z] for a, z in zip(starts[w : w + k].tolist(), ends[w : w + k].tolist(), strict=True)) == want

    def _doc_bytes(self) -> list[int]:
        return self.lengths

    lengths: list[int]


def shards(batches, id_col: str, text_col: str):
    """Shards of a task's batches; one never spans batches, so results line up with them."""
    for b in batches:
        shard = Shard()
        shard.lengths = []
        for ids, data, offs in text_slices(iter([b]), id_col, text_col, SLICE_BYTES):
            shard.add(ids, data, offs)
            shard.lengths += np.diff(offs).tolist()
            if shard.n >= SHARD_SYMBOLS or sum(len(d) for d in shard.data) >= SHARD_BYTES:
                yield b, shard
                shard = Shard()
                shard.lengths = []
        if shard.ids:
            yield b, shard


SCAN = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items that occur, and the merged removal spans in UTF-8 bytes."""
    paths = compile_benchmark(benchmark, window)

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for _, shard in shards(batches, "doc_id", "text"):
            rows = shard.scan(paths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([len(r[3]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in rows]),
                    pa.array([r[2] > 0 for r in rows]),
                    pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": z} for a, z in r[4]] for r in rows], span),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their removal spans cut out (each leaves one blank); documents of benchmark words only go.

    ``n_chars``, where there is one, is the length of the text that stays. Documents without a hit are unchanged.
    """
    paths = compile_benchmark(benchmark, window)

    def run(batches):
        for b in batches:
            done = 0
            for _, shard in shards(iter([b]), "doc_id", "text"):  # rows leave shard by shard: a batch holds ten thousand texts
                rows = b.slice(done, len(shard.ids))
                done += len(shard.ids)
                yield _cut_rows(rows, shard.scan(paths))
            tidy()

    return docs.mapInArrow(run, docs.schema)


def _cut_rows(rows: pa.RecordBatch, scanned: list[tuple]) -> pa.RecordBatch:
    """Rows without what was scanned as hit; only texts with a hit are taken apart."""
    names = rows.schema.names
    keep = pa.array([not hit or hit < n for _, n, hit, _, _ in scanned])
    changed = {}
    for k, (_, _, hit, _, spans) in enumerate(scanned):
        if hit:
            raw, at, parts = rows.column(names.index("text"))[k].as_py().encode(), 0, []
            for a, z in spans:
                parts.append(raw[at:a])
                at = z
            parts.append(raw[at:])
            changed[k] = b" ".join(parts).decode()
    if changed:
        hits = pa.array([k in changed for k in range(len(scanned))])
        put = lambda name, values: pc.replace_with_mask(rows.column(names.index(name)), hits, pa.array(values, rows.schema.field(name).type))
        new = {"text": put("text", list(changed.values()))}
        if "n_chars" in names:
            new["n_chars"] = put("n_chars", [len(x) for x in changed.values()])
        rows = pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(names)], names)
    return rows.filter(keep)
