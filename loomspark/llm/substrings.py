"""Exact removal of repeated substrings (400 bytes by default) with suffix arrays built in two stages.

Every string of SHORTER bytes contains one anchor: its right-most minimum under a hash of its 100-byte grams. Equal
strings have equal anchors at equal offsets, and a 400-byte string that repeats begins with a shorter one that does, so

1. a scan finds each document's anchors (about one in 75 bytes) with the range of string starts that each owns;
   anchors that a task meets several times are known to repeat and go on at once, with one witness for the others; packed
   (hash, place) entries of the rest are dealt to buckets, and anchors that occur once go: no string they own repeats;
2. of the others the slice of text that their strings span is cut out; equal slices are counted before they move;
3. slices of one anchor that differ meet in a bucket's suffix array. Two-stage sorting: suffixes smaller than their
   successor are sorted directly, the rest is induced by scanning the buckets of first bytes in order; then common
   prefixes of neighbours of 400 bytes or more mark repeated strings, and those of SHORTER or more what is only counted;
4. repeated starts go back to every document that holds the slice, and the bytes they cover are removed.

Passages of some fifty words are often shorter than 400 bytes. ``n_repeated`` tells how many bytes strings of SHORTER
bytes cover that begin elsewhere too; they are counted, not removed.

Nulls: a null text is empty. Rows with a null doc_id are documents of their own: they are numbered internally, as
are rows that repeat a doc_id, so no row is lost or merged. Empty tables give empty results. Extra columns are
ignored by ``removed`` and kept by nothing here: the operator returns its own columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _M, _MINV, _pow, buckets_for, materialize, mix64, text_slices

LENGTH = 400
GRAM = 100
#: Bytes of repeated strings that are counted beside those that are removed.
SHORTER = 240
BUCKET_MB = 2.0
FLUSH = 500_000
SORT_STARTS = 400_000  # suffixes of one suffix array, about


PLACE = np.uint64((1 << 20) - 1)  # low bits of a key that hold a place


def sliding_min_right(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values, the position of its right-most minimum (of the high 44 bits)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = int(PLACE) + 1 - w
    if n > most:  # places fit 20 bits: longer texts go in parts
        return np.concatenate([sliding_min_right(h[a : a + most + w - 1], w) + a for a in range(0, n, most)])
    pad = (-len(h)) % w
    x = np.full(len(h) + pad, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    x = x.reshape(-1, w)
    prefix = np.minimum.accumulate(x, axis=1).ravel()
    suffix = np.ascontiguousarray(np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])
    return (PLACE - (least & PLACE)).astype(np.int64)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, last start) of each anchor of a text: the starts whose string it represents."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    v = RAW[data] * _pow(_M, n, "m")
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(v, out=c[1:])
    h = mix64((c[gram:] - c[:-gram]) * _pow(_MINV, n - gram + 1, "i"))
    at = sliding_min_right(h, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], first, last


RAW = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


# ---------------------------------------------------------------- the suffix array


def two_stage(slices: list[bytes], lasts: list[int], length: int = LENGTH, shorter: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over the first lasts[k]+1 starts of each slice, ordered by their first ``length`` bytes.

    Returns (slice number, start, shared) in order: whether the neighbour before shares ``length`` bytes. With ``shorter``
    shared is 2 there, 1 where the neighbours share as many bytes as that, else 0.
    """
    text = np.frombuffer(b"".join(slices), np.uint8)
    sizes = np.array([len(s) for s in slices], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = len(text)
    # type: smaller than the successor (S) or larger (L); a slice's last suffix is larger than nothing, so L
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    up[base + sizes - 1] = -1
    nz = np.flatnonzero(up)
    small = up[nz[np.searchsorted(nz, np.arange(n))]] > 0
    # the part of each slice that takes part: up to the first S at or after its last start
    s_at = np.flatnonzero(small)
    ends = np.empty(len(slices), np.int64)
    for k, last in enumerate(lasts):
        j = np.searchsorted(s_at, base[k] + last)
        stop = base[k] + sizes[k] - 1
        ends[k] = s_at[j] if j < len(s_at) and s_at[j] <= stop else stop
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, base, 1)
    np.add.at(inside, ends + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    direct = inside & small
    direct[ends] = True
    owner = np.repeat(np.arange(len(slices)), sizes)
    place = np.flatnonzero(direct)
    # stage 1: sort the S suffixes directly, by first byte and then by their bytes, few keys in memory at a time
    first_byte = text[place]
    seeds: dict[int, np.ndarray] = {}
    small_part: dict[int, np.ndarray] = {}
    for c in np.unique(first_byte).tolist():
        p = place[first_byte == c]
        done: list[np.ndarray] = []
        _sort_into(done, p, slices, owner, base, length, 1)
        order = np.concatenate(done)
        small_part[c] = order[small[order]]
        seeds[c] = order[~small[order]]
    # stage 2: induce the L suffixes by scanning the buckets in order
    heads: dict[int, list[np.ndarray]] = {c: [x] for c, x in seeds.items() if len(x)}
    start_of = np.zeros(n, bool)
    start_of[base] = True
    sa = []
    empty = np.zeros(0, np.int64)

    def before(x: np.ndarray) -> np.ndarray:
        p = x[~start_of[x]] - 1
        return p[~small[p] & inside[p] & ~direct[p]]

    for c in range(256):
        if c not in heads and c not in small_part:
            continue
        part = heads.pop(c, [])
        front = np.concatenate(part) if part else empty
        large = [front]
        while len(front):
            p = before(front)
            front = p[text[p] == c]
            if len(front):
                large.append(front)
        row = np.concatenate([*large, small_part.get(c, empty)])
        sa.append(row)
        p = before(row)
        p = p[text[p] > c]
        if len(p):
            t = text[p]
            order = np.argsort(t, kind="stable")
            p, t = p[order], t[order]
            cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(t)).tolist(), strict=True):
                heads.setdefault(int(t[a]), []).append(p[a:z])
    sa = np.concatenate(sa) if sa else empty
    who, off = owner[sa], sa - base[owner[sa]]
    keep = off <= np.asarray(lasts, np.int64)[who]
    who, off = who[keep], off[keep]
    same = np.zeros(len(who), np.int8)
    w, o, probe = who.tolist(), off.tolist(), min(24, length)
    for i in range(1, len(w)):  # common prefix of neighbours, as far as it decides
        a, b = slices[w[i - 1]], slices[w[i]]
        x, y = o[i - 1], o[i]
        if a[x : x + probe] == b[y : y + probe]:
            p, q = a[x : x + length], b[y : y + length]
            if p == q and len(p) == length:
                same[i] = 2
            elif shorter and p[:shorter] == q[:shorter] and len(p) >= shorter <= len(q):
                same[i] = 1
    return who, off, same if shorter else same > 0


def _sort_into(done: list[np.ndarray], p: np.ndarray, slices: list[bytes], owner: np.ndarray, base: np.ndarray, length: int, depth: int) -> None:
    """Sort suffixes that share ``depth`` bytes; large sets are split by the next byte first, so few keys are in memory."""
    who = owner[p]
    off = (p - base[who]).tolist()
    who = who.tolist()
    if len(p) <= 60_000 or depth >= length:
        keys = [slices[w][o + depth : o + length] for w, o in zip(who, off, strict=True)]
        order = sorted(range(len(p)), key=keys.__getitem__)
        done.append(p[order])
        return
    nxt = np.array([slices[w][o + depth] if o + depth < len(slices[w]) else -1 for w, o in zip(who, off, strict=True)], np.int16)
    for c in np.unique(nxt).tolist():
        _sort_into(done, p[nxt == c], slices, owner, base, length, depth + 1)


# ---------------------------------------------------------------- Spark


WITNESS = -1  # in place of a start: the anchor repeats in a task that has passed its places on
DEALT = "bucket int, hash binary, doc binary, lo binary, hi binary"
REPEATED = "doc long, lo int, hi int, hash long"


def _deal(n_buckets: int, length: int, gram: int):
    def run(batches):
        held: list[tuple] = []
        n = 0

        def packed(buckets, cuts, columns):
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32())] + [pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for x in columns], ["bucket", "hash", "doc", "lo", "hi"])

        def flush():
            nonlocal held, n
            h, d, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, d, lo, hi = h[order], d[order], lo[order], hi[order]
            again = h[1:] == h[:-1]
            many = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            if many.any():  # known to repeat: they pass by the buckets, but for one witness each
                yield packed([-1 - int(h[0] % np.uint64(n_buckets))], [(0, int(many.sum()))], [x[many] for x in (h, d, lo, hi)])
                first = many & np.concatenate([[True], ~again])
                lo = np.where(first, WITNESS, lo).astype(np.int32)
                keep = first | ~many
                h, d, lo, hi = h[keep], d[keep], lo[keep], hi[keep]
            b = (h % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(n_buckets + 1))
            some = [k for k in range(n_buckets) if cut[k] < cut[k + 1]]
            yield packed(some, [(cut[k], cut[k + 1]) for k in some], [x[order] for x in (h, d, lo, hi)])
            held, n = [], 0

        for ids, data, offs in text_slices(batches, "doc", "text"):
            for k, doc in enumerate(ids):
                h, lo, hi = anchors(data[offs[k] : offs[k + 1]], length, gram)
                if len(h):
                    held.append((h, np.full(len(h), doc, np.int64), lo.astype(np.int32), hi.astype(np.int32)))
                    n += len(h)
            if n >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _repeated(key, table):
    h, d, lo, hi = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hash", np.uint64), ("doc", np.int64), ("lo", np.int32), ("hi", np.int32)))
    keep = np.arange(len(h))
    if key[0].as_py() >= 0 and len(h):
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        keep = keep[lo[keep] != WITNESS]
    return pa.table({"doc": d[keep], "lo": lo[keep], "hi": hi[keep], "hash": h[keep].view(np.int64)})


SLICES = "doc long, lo int, hash long, slice_id binary, last int, slice binary"


def _cut(length: int):
    def run(batches):
        for b in batches:
            docs, texts, marks = b.column(0).to_pylist(), b.column(1), b.column(2)
            seen: set[bytes] = set()
            rows = []
            for k, doc in enumerate(docs):
                raw = (texts[k].as_py() or "").encode()
                for m in marks[k].as_py():
                    piece = raw[m["lo"] : m["hi"] + length]
                    key = hashlib.blake2b(piece, digest_size=16).digest()
                    rows.append((doc, m["lo"], m["hash"], key, m["hi"] - m["lo"], None if key in seen else piece))
                    seen.add(key)
                if len(rows) >= 20_000:
                    yield _slice_batch(rows)
                    rows = []
            if rows:
                yield _slice_batch(rows)

    return run


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.binary())], ["doc", "lo", "hash", "slice_id", "last", "slice"])


def _arrays(length: int, shorter: int):
    def run(key, table):
        """Of one bucket, the repeated starts of each slice as runs (first, last)."""
        hashes = np.asarray(table.column("hash"))
        order = np.argsort(hashes, kind="stable")
        ids, lasts, times, texts = (table.column(c).to_pylist() for c in ("slice_id", "last", "times", "slice"))
        out_id, out_runs, out_also = [], [], []

        def edges(hit: np.ndarray) -> list[int]:
            return [int(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))]

        def runs(k: int, level: np.ndarray) -> None:
            if level.any():
                out_id.append(ids[k])
                out_runs.append(edges(level == 2))
                out_also.append(edges(level > 0))

        def alone(k: int) -> np.ndarray:
            """Levels of a slice's starts that its own copies give: long strings need their bytes."""
            level = np.full(lasts[k] + 1, times[k] > 1, np.int8)
            level[: max(0, min(lasts[k] + 1, len(texts[k]) - length + 1))] *= 2
            return level

        def sort(some: list[int]) -> None:
            who, off, same = two_stage([texts[k] for k in some], [lasts[k] for k in some], length, shorter)
            best = same.copy()
            best[:-1] = np.maximum(best[:-1], same[1:])
            level = {k: alone(k) for k in some}
            at = np.flatnonzero(best)
            for w, o, x in zip(who[at].tolist(), off[at].tolist(), best[at].tolist(), strict=True):
                level[some[w]][o] = max(level[some[w]][o], x)
            for k in some:
                runs(k, level[k])

        held, starts = [], 0
        cut = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
            group = order[a:z].tolist()
            if len(group) == 1:  # one slice, met several times or once
                runs(group[0], alone(group[0]))
                continue
            held += group
            starts += sum(lasts[k] + 1 for k in group)
            if starts >= SORT_STARTS:
                sort(held)
                held, starts = [], 0
        if held:
            sort(held)
        return pa.table({"slice_id": pa.array(out_id, pa.binary()), "runs": pa.array(out_runs, pa.list_(pa.int32())), "also": pa.array(out_also, pa.list_(pa.int32()))})

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans array<struct<start:long,end:long>>"


def _merged(parts: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals put together where they meet."""
    spans: list[list[int]] = []
    for a, z in sorted(parts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    return spans


def _remove(length: int, shorter: int):
    def covered(marks, name: str, size: int) -> list[list[int]]:
        return _merged([(m["lo"] + x, m["lo"] + y - 1 + size) for m in marks or [] for x, y in zip(m[name][::2], m[name][1::2], strict=True)])

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = covered(marks, "runs", length)
                at, kept = 0, hashlib.sha256()
                for a, z in spans:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                rows.append((doc, len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest(), sum(z - a for a, z in covered(marks, "also", shorter)), [{"start": a, "end": z} for a, z in spans]))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c[:4]] + [pa.array(c[4]), pa.array(c[5], pa.int64()), pa.array(c[6], span)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans"])

    return run


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shorter: int = SHORTER) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, spans (UTF-8 bytes)."""
    shorter = max(min(shorter, length), gram)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = base.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d"), F.count(F.lit(1)).alias("all")).first()
    if n["n"] == n["d"] == n["all"]:
        base = base.withColumn("doc", F.col("doc_id"))
    else:  # ids that are null or repeat: number the rows
        base = materialize(base.withColumn("doc", F.monotonically_increasing_id()), "substring-rows")
    n_buckets = buckets_for(docs.select("text"), BUCKET_MB)
    dealt = base.select("doc", "text").filter(F.octet_length("text") >= shorter).mapInArrow(_deal(n_buckets, shorter, gram), DEALT)
    marks = materialize(dealt.groupBy("bucket").applyInArrow(_repeated, REPEATED), "substring-marks")
    by_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "hash")).alias("marks"))
    slices = materialize(base.select("doc", "text").join(by_doc, "doc").mapInArrow(_cut(length), SLICES), "substring-slices")
    counted = slices.groupBy("hash", "slice_id", "last").agg(F.count(F.lit(1)).alias("times"), F.max("slice").alias("slice"))
    counted = counted.withColumn("bucket", F.pmod(F.col("hash"), F.lit(n_buckets)).cast("int"))
    found = materialize(counted.groupBy("bucket").applyInArrow(_arrays(length, shorter), "slice_id binary, runs array<int>, also array<int>"), "substring-found")
    hits = slices.select("doc", "lo", "slice_id").join(found, "slice_id").groupBy("doc").agg(F.collect_list(F.struct("lo", "runs", "also")).alias("marks"))
    return base.select("doc", "doc_id", "text").join(hits, "doc", "left").select("doc_id", "text", "marks").mapInArrow(_remove(length, shorter), OUT)
