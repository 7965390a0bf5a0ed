"""N-gram Jaccard join: which documents' sets of 5-word shingles overlap by 0.8 or more, exactly.

The join is a blocked sparse product of the document by n-gram incidence. Two sets that link differ in at most
H = (|x| + |y|) / 9 n-grams. So the n-gram space (the columns) is cut into blocks, a few more than H for documents
of a size class: by the pigeonhole principle a linked pair has a block in which their columns are the same and not
empty. A block's content becomes one key, and

1. keys are dealt to buckets as packed numbers, and a bucket's product lists the documents that share a key; a
   document that shares none with another has no overlap that could reach the bound and is dropped here;
2. each document is held against the document it shares most keys with: their overlap is accumulated over the
   whole rows, and links become components (near copies never meet pair by pair);
3. lists that still hold several components are multiplied block by block: sizes and the parity of their n-grams in
   some thousand columns bound the overlap from above and pairs below the size-derived bound go. In the first rounds each
   document counts its overlap only with the document of another component that the bound leaves nearest, so that
   components of one group grow together at a cost in proportion to its documents; a last round counts all pairs of
   documents that are in different components still. After the first round a list has only those documents left that the
   bound lets near another one.

No link is lost: a pair is left out only if a bound rules it out or both are in one component already. Documents
with equal sets meet in one key of their own and need no count. Every step is keyed by n-gram blocks, document or
pair; the driver gathers nothing.

Nulls: a null text is empty; a document without words has no shingles and links with nothing; rows with a null
doc_id get no links and a null component. Rows that repeat a doc_id are one node, with the links of all of them.
Empty tables give empty results. Extra columns are ignored by ``links`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, components, discard, materialize, mix64, shingle_sets, text_slices, tidy

SHINGLE = 5
BITS = 1024
FLUSH = 800_000  # keys in a task's memory before they are dealt out
SEEN = 500_000  # equal sets a task remembers
BUCKET_MB = 2.0

_classes: list[tuple[int, int, int]] = []  # (smallest size, differences, blocks)


def size_classes() -> list[tuple[int, int, int]]:
    """Size classes in which a size and its 1.25-fold are at most one class apart."""
    if not _classes:
        lo = 1
        while lo < 1 << 40:
            hi = lo * 5 // 4
            differ = 2 * hi // 9
            blocks = 1 if differ == 0 else differ + 1 + 2 + (differ + 1) * 3 // 20
            _classes.append((lo, differ, blocks))
            lo = hi + 1
    return _classes


_LOWS = np.array([c[0] for c in size_classes()])


def block_keys(u: np.ndarray) -> np.ndarray:
    """Keys of a sorted set: the content of each non-empty block of its columns, for its own size class and the next.

    If so many blocks are empty that a linked pair's equal blocks could all be, the empty ones are keys too.
    """
    n = len(u)
    own = int(np.searchsorted(_LOWS, n, side="right")) - 1
    top, content = u >> np.uint64(32), mix64(u)
    out = []
    for label in (own, own + 1):
        _, differ, blocks = size_classes()[label]
        part = ((top * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(content, first)
        tag = np.uint64(label << 40)
        out.append(mix64(sums + mix64(part[first].astype(np.uint64) + tag)))
        if blocks > 1 and blocks - len(first) >= blocks - differ:
            empty = np.setdiff1d(np.arange(blocks), part[first])
            out.append(mix64(mix64(empty.astype(np.uint64) + tag) ^ np.uint64(0xE3E3E3E3E3E3E3E3)))
    return np.concatenate(out)


def set_key(u: np.ndarray) -> int:
    """A key of the whole set."""
    one, two = (int(mix64(u ^ np.uint64(k)).sum(dtype=np.uint64)) for k in (0x5BD1E995, 0x2545F491))
    return int(mix64(np.array([(one ^ two * 3) & (1 << 64) - 1], np.uint64))[0]) | 1


def parity_bits(u: np.ndarray) -> bytes:
    """Parity of the set's n-grams in at least twice as many columns: two sets' bits differ in at most as many places as the sets do."""
    columns = max(BITS, 1 << int(2 * len(u) - 1).bit_length()) if len(u) else BITS
    return np.packbits(np.bincount((u & np.uint64(columns - 1)).astype(np.int64), minlength=columns) & 1).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Parities in fewer columns: the last axis halved until it has ``size`` words."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Sizes and parities do not rule out a link."""
    if 5 * min(na, nb) < 4 * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * 9 <= na + nb


DEALT = "bucket int, keys binary, docs binary, exact binary, exact_docs binary, meta_docs binary, meta_n binary, twin_a binary, twin_b binary"
LISTS = "kind int, docs array<long>, n long"


def _deal(n_buckets: int):
    def run(batches):
        seen: dict[int, int] = {}
        keys, docs, exact, exact_docs, meta_docs, meta_n, twin_a, twin_b, held, turn = [], [], [], [], [], [], [], [], 0, 0

        def flush():
            nonlocal keys, docs, exact, exact_docs, meta_docs, meta_n, twin_a, twin_b, held, turn
            k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            d = np.repeat(np.array(docs, np.int64), [len(x) for x in keys]) if keys else np.zeros(0, np.int64)
            e, ed = np.array(exact, np.uint64), np.array(exact_docs, np.int64)
            kb, eb = (k % np.uint64(n_buckets)).astype(np.int64), (e % np.uint64(n_buckets)).astype(np.int64)
            ko, eo = np.argsort(kb, kind="stable"), np.argsort(eb, kind="stable")
            k, d, e, ed = k[ko], d[ko], e[eo], ed[eo]
            kc, ec = np.searchsorted(kb[ko], np.arange(n_buckets + 1)), np.searchsorted(eb[eo], np.arange(n_buckets + 1))
            rows = []
            for b in range(n_buckets):
                if kc[b] < kc[b + 1] or ec[b] < ec[b + 1]:
                    rows.append((b, k[kc[b] : kc[b + 1]].tobytes(), d[kc[b] : kc[b + 1]].tobytes(), e[ec[b] : ec[b + 1]].tobytes(), ed[ec[b] : ec[b + 1]].tobytes(), b"", b"", b"", b""))
            turn += 1
            rows.append(((turn * 7919 + (meta_docs[0] if meta_docs else 0)) % n_buckets, b"", b"", b"", b"", np.array(meta_docs, np.int64).tobytes(), np.array(meta_n, np.int64).tobytes(), np.array(twin_a, np.int64).tobytes(), np.array(twin_b, np.int64).tobytes()))
            keys, docs, exact, exact_docs, meta_docs, meta_n, twin_a, twin_b, held = [], [], [], [], [], [], [], [], 0
            for a in range(0, len(rows), 1000):
                cols = list(zip(*rows[a : a + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], [x.split()[0] for x in DEALT.split(", ")])

        for ids, data, offs in text_slices(batches, "doc_id", "text"):
            for doc, u in zip(ids, shingle_sets(data, offs, SHINGLE), strict=True):
                meta_docs.append(doc)
                meta_n.append(len(u))
                if not len(u):
                    continue
                whole = set_key(u)
                if whole in seen:  # equal sets inside a task are linked here, so a bucket gets one row a task of each
                    twin_a.append(seen[whole])
                    twin_b.append(doc)
                    continue
                exact.append(whole)
                exact_docs.append(doc)
                if len(seen) >= SEEN:
                    seen.clear()
                seen[whole] = doc
                keys.append(block_keys(u))
                docs.append(doc)
                held += len(keys[-1])
            if held >= FLUSH or len(meta_docs) >= 100_000:
                yield from flush()
        if meta_docs:
            yield from flush()

    return run


def _runs(keys: np.ndarray, docs: np.ndarray) -> dict[bytes, int]:
    """Distinct lists (sorted document numbers as bytes) of documents that share a key, with how many keys they share."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d = k[keep], d[keep]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(k))
    out: dict[bytes, int] = {}
    for a, z in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
        x = d[a:z].tobytes()
        out[x] = out.get(x, 0) + 1
    return out


def _product(key, table):
    """A bucket's lists: kind 0 shares blocks, kind 1 has equal sets, kind 3 pairs of them from one task, kind 2 carries documents with their sizes through."""

    def joined(c, t):
        return np.frombuffer(b"".join(table.column(c).to_pylist()), t)

    kinds, lists, ns = [], [], []
    for kind, (a, b) in enumerate((("keys", "docs"), ("exact", "exact_docs"))):
        for x, n in _runs(joined(a, np.uint64), joined(b, np.int64)).items():
            kinds.append(kind)
            lists.append(np.frombuffer(x, np.int64))
            ns.append(n)
    a, b = joined("twin_a", np.int64), joined("twin_b", np.int64)
    for lo in range(0, len(a), 100_000):
        kinds.append(3)
        lists.append(np.stack([a[lo : lo + 100_000], b[lo : lo + 100_000]], 1).ravel())
        ns.append(0)
    docs, sizes = joined("meta_docs", np.int64), joined("meta_n", np.int64)
    for n in np.unique(sizes).tolist():
        kinds.append(2)
        lists.append(docs[sizes == n])
        ns.append(n)
    out = pa.table({"kind": pa.array(kinds, pa.int32()), "docs": pa.array(lists, pa.list_(pa.int64())), "n": pa.array(ns, pa.int64())})
    del lists, table
    tidy()
    return out


def _sets(batches):
    for ids, data, offs in text_slices(batches, "doc_id", "text"):
        sets = list(shingle_sets(data, offs, SHINGLE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(u) for u in sets], pa.int64()), pa.array([parity_bits(u) for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())], ["doc", "n", "bits", "grams"]
        )


def _count(batches):
    for b in batches:
        a, c = b.column(0), b.column(1)
        link = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            link.append(100 * both >= 80 * (len(x) + len(y) - both))
        out = pa.RecordBatch.from_arrays([a, c, pa.array(link, pa.bool_())], ["a", "b", "link"])
        yield out.filter(out.column(2))
    tidy()


def _prune(batches):
    for b in batches:
        ok = [may_link(*r) for r in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    tidy()


def count_overlaps(pairs: DataFrame, sets: DataFrame, pruned: bool = False) -> DataFrame:
    """Pairs (a, b) whose exact overlap is a link. Sizes and parities rule pairs out before whole rows move."""
    if not pruned:
        small = sets.select("doc", "n", "bits")
        rows = pairs.select("a", "b").join(small.select(F.col("doc").alias("b"), F.col("bits").alias("xb"), F.col("n").alias("nb")), "b")
        rows = rows.join(small.select(F.col("doc").alias("a"), F.col("bits").alias("xa"), F.col("n").alias("na")), "a")
        pairs = materialize(rows.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(_prune, "a long, b long"), "jaccard-near")
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb"))
    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a")
    return rows.select("a", "b", "ga", "gb").mapInArrow(_count, "a long, b long, link boolean").select("a", "b").distinct()


#: Documents of a list in one block; a task holds two blocks of it against each other.
LIST_BLOCK = 2048
#: Most rounds in which documents are held against the nearest one of another component, before all that are left.
ROUNDS = 4
#: Rows of short lists that go to one task, pairs held at a time (or words of their parities), and rows of a tile of a longer list.
TOGETHER = 4096
PAIRS = 500_000
TILE = 512


def _bounded(key, table):
    """All pairs of ``_product_of_blocks``."""
    return _product_of_blocks(key, table, False)


def _nearest(key, table):
    """Of the pairs of ``_bounded`` those that are the nearest of one of their documents."""
    return _product_of_blocks(key, table, True)


def _pairs_of(first: np.ndarray, size: np.ndarray):
    """All pairs of rows of each list (its first row, its number of rows), about half a million at a time; lists of one size at once."""
    for n in np.unique(size[size > 1]).tolist():
        at = first[size == n]
        if n <= TILE:
            i, j = np.triu_indices(n, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            continue
        for lo in at.tolist():
            for i in range(0, n, TILE):
                for j in range(i, n, TILE):
                    r, c = (x.ravel() for x in np.meshgrid(np.arange(i, min(n, i + TILE)), np.arange(j, min(n, j + TILE)), indexing="ij"))
                    yield (lo + r[r < c], lo + c[r < c]) if i == j else (lo + r, lo + c)


def _product_of_blocks(key, table, nearest):
    """Of whole lists, or of two blocks of one list, the pairs from different components that sizes and parities do not rule out.

    With ``nearest``, for each document of a list only the pair whose parities differ least for its size.
    """
    lists, doc, comp, n, side = (np.asarray(table.column(c)) for c in ("list", "doc", "comp", "n", "side"))
    order = np.lexsort((doc, lists))
    lists, doc, comp, n, side = (x[order] for x in (lists, doc, comp, n, side))
    one = key[1].as_py() == key[2].as_py()
    raw = table.column("bits").to_pylist()
    words = np.array([len(raw[k]) // 8 for k in order.tolist()], np.int64)
    place, packed = np.zeros(len(doc), np.int64), {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        place[at] = np.arange(len(at))
        packed[w] = np.frombuffer(b"".join([raw[k] for k in order[at].tolist()]), np.uint64).reshape(len(at), w)
    del raw
    first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    l_out, a_out, b_out = [], [], []
    least, partner = np.full(len(doc), np.inf), np.full(len(doc), -1)
    for r, c in _pairs_of(first, np.diff(np.append(first, len(doc)))):
        ok = (comp[r] != comp[c]) & (one | (side[r] != side[c])) & (5 * np.minimum(n[r], n[c]) >= 4 * np.maximum(n[r], n[c]))
        r, c = r[ok], c[ok]
        size = np.minimum(words[r], words[c])
        for w in np.unique(size).tolist():  # the same number of columns on both sides, so many pairs at a time as fit
            rw, cw = r[size == w], c[size == w]
            used = np.unique(np.concatenate([rw, cw]))
            rows = np.empty((len(used), w), np.uint64)
            for own in np.unique(words[used]).tolist():
                rows[words[used] == own] = folded(packed[own][place[used[words[used] == own]]], w)
            ru, cu = np.searchsorted(used, rw), np.searchsorted(used, cw)
            step = max(1, PAIRS // w)
            for k in range(0, len(rw), step):
                x, y = rw[k : k + step], cw[k : k + step]
                differ = np.bitwise_count(rows[ru[k : k + step]] ^ rows[cu[k : k + step]]).sum(1, dtype=np.int64) * 9
                near = differ <= n[x] + n[y]
                x, y = x[near], y[near]
                if not nearest:
                    l_out.append(lists[x])
                    a_out.append(doc[x])
                    b_out.append(doc[y])
                    continue
                far = np.tile(differ[near] / (n[x] + n[y]), 2)
                by_far = np.argsort(far, kind="stable")
                each, other = np.concatenate([x, y])[by_far], np.concatenate([y, x])[by_far]
                at, where = np.unique(each, return_index=True)
                better = far[by_far][where] < least[at]
                least[at[better]], partner[at[better]] = far[by_far][where][better], other[where][better]
    if nearest:
        at = np.flatnonzero(partner >= 0)
        l_out, a_out, b_out = [lists[at]], [doc[at]], [doc[partner[at]]]
    of, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (l_out, a_out, b_out))
    pairs = np.unique(np.stack([of, np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pairs = pairs[pairs[:, 1] != pairs[:, 2]]
    out = pa.table({"list": pa.array(pairs[:, 0]), "a": pa.array(pairs[:, 1]), "b": pa.array(pairs[:, 2])})
    del packed, table
    tidy()
    return out


def _open(entries: DataFrame, comp: DataFrame, tag: str) -> DataFrame:
    """(list, doc, comp, blocks) of the lists that hold several components."""
    tagged = entries.select("list", "doc").join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").select("list", "doc", F.coalesce("component", "doc").alias("comp"))
    tagged = materialize(tagged, f"{tag}-tagged")
    several = tagged.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks")).filter("lo <> hi").select("list", "blocks")
    out = materialize(tagged.join(several, "list"), f"{tag}-open")
    discard(tagged)
    return out


def _grown(entries: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame:
    """Components after all links inside lists that hold several of them."""
    small = sets.select("doc", "n", "bits")
    last, found = False, None
    for turn in range(ROUNDS + 1):
        opened = _open(entries, comp, f"jaccard-{turn}")
        if found is not None:
            discard(found)
        total = opened.count()
        if not total:
            discard(opened)
            break
        own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
        dealt = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # lists of one block go many to a task
        deal = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("list"), F.lit(total // TOGETHER + 1))).otherwise(F.col("list"))
        dealt = dealt.select(deal.alias("deal"), "list", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "comp")
        found = dealt.join(small, "doc").groupBy("deal", "p", "q").applyInArrow(_bounded if last else _nearest, "list long, a long, b long")
        found = materialize(found, f"jaccard-pairs{turn}")
        discard(opened)
        more = materialize(count_overlaps(found.select("a", "b").distinct(), sets, pruned=True), f"jaccard-more{turn}")
        settled = more.isEmpty()
        if not settled:
            # a component is a star by now, so only the new links take rounds
            comp = materialize(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), f"jaccard-cc{turn}"), f"jaccard-comp{turn}")
        if last:
            discard(found)
            break
        # the bounds do not depend on components: a document that is near no other in a list need not be looked at there again
        entries = found.select("list", F.col("a").alias("doc")).union(found.select("list", F.col("b").alias("doc"))).distinct()
        last = settled or turn == ROUNDS - 1
    return comp


def links(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = base.filter("doc_id is not null")
    n_buckets = buckets_for(named, BUCKET_MB)
    dealt = named.mapInArrow(_deal(n_buckets), DEALT)
    lists = materialize(dealt.groupBy("bucket").applyInArrow(_product, LISTS), "jaccard-lists")

    exact = lists.filter("kind = 1").select(F.element_at("docs", 1).alias("a"), F.explode("docs").alias("b")).filter("a <> b")
    at = F.sequence(F.lit(0), F.size("docs") - 2, F.lit(2))
    twins = lists.filter("kind = 3").select(F.explode(F.transform(at, lambda i: F.struct(F.get("docs", i).alias("a"), F.get("docs", i + 1).alias("b")))).alias("p")).select("p.a", "p.b")
    exact = exact.union(twins.filter("a <> b"))
    shared = lists.filter("kind = 0").groupBy("docs").agg(F.sum("n").alias("n"))
    shared = materialize(shared.withColumn("list", F.monotonically_increasing_id()), "jaccard-shared")
    entries = shared.select("list", F.explode("docs").alias("doc"))

    wanted = entries.select(F.col("doc").alias("doc_id")).distinct()
    sets = materialize(named.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc long, n long, bits binary, grams binary"), "jaccard-sets")

    star = shared.select("n", F.element_at("docs", 1).alias("a"), F.explode("docs").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = star.groupBy("b").agg(F.max_by("a", F.struct(F.col("n"), -F.col("a"))).alias("a"))
    first = materialize(count_overlaps(best, sets), "jaccard-first")
    comp = materialize(components(first.union(exact), "jaccard-a"), "jaccard-comp")
    comp = _grown(entries, sets, comp)

    sizes = lists.filter("kind = 2").select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"))
    out = sizes.join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = base.filter("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long")
    return out.unionByName(nameless)


def _sizes(batches):
    for ids, data, offs in text_slices(batches, "doc_id", "text"):
        n = [len(u) for u in shingle_sets(data, offs, SHINGLE)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(ids), pa.int64())], ["doc_id", "n_shingles", "component_id"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those linked to a smaller doc_id's group: of each group the smallest doc_id stays."""
    gone = links(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
