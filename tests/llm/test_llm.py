"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import io
import math
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontam, jaccard, lines, media, mixing, pii, quality, substrings, tokens, warc
from loomspark.llm.common import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu été größe niño".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, doc string, n long, a int, hash string"


def corpus(seed=1, n=60):
    """Small texts with copies, near copies, shared passages, nulls, empty and long ones, repeated ids."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(k))
    passage = text(70)
    out = [text(r.randrange(1, 90)) for _ in range(n)]
    out += [out[3], out[3], out[3].upper(), out[5] + " tail", passage, "x " + passage + " y", text(20) + "\n" + passage + "\n" + text(9), passage + passage]
    long = text(260)
    out += [long, " ".join(w if i % 40 else "edit" + str(i) for i, w in enumerate(long.split())), "", None, None, " \n\t ", "word", "a b c d", "a b c d", "a b c d e", text(6000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "c", "d", 1, 2, "h") for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1


def contract_words(t):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, docs, empty):
    rows = corpus()
    items = [("i1", rows[64][1][:200]), ("i2", " ".join(rows[2][1].split()[:4])), ("i3", None), ("i4", "nowhere to be found"), (None, rows[3][1]), ("i1", rows[10][1]), ("i5", "--")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = contract_words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[a : a + k])].add(i or "null")
    want = {}
    for d, t, *_ in rows:
        w, hit, found = contract_words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (o := wins.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= o
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.scan(docs, bench).collect()}
    assert got == want and any(v[4] for v in want.values())
    small = {r.doc_id: r.n_hit for r in decontam.scan(docs, bench.repartition(3)).collect()}
    assert small == {k: v[1] for k, v in want.items()}
    cut = {r.doc_id: r for r in decontam.cut(docs, bench).collect()}
    assert all(cut[d].text == t and cut[d].n_chars == n for d, t, _, _, n, *_ in rows if not want[d][4])
    assert all(not want[d][4] or want[d][1] < want[d][0] for d in cut) and all(cut[d].n_chars == len(cut[d].text) for d in cut if want[d][4])
    assert decontam.scan(empty, bench).count() == 0 and decontam.scan(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_fm_index():
    r = np.random.default_rng(3)
    for _ in range(30):
        s = r.integers(0, 4, r.integers(1, 60)).astype(np.int32)
        x = decontam.FMIndex(s, 3)
        pats = np.zeros((20, 4), np.int32)
        lens = r.integers(1, 5, 20)
        for i in range(20):
            pats[i, : lens[i]] = r.integers(1, 4, lens[i])
        which, lo, hi = x.search(pats, lens)
        got = {int(w): sorted(x.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
        for i in range(20):
            p = pats[i, : lens[i]].tolist()
            at = [k for k in range(len(s) - len(p) + 1) if s[k : k + len(p)].tolist() == p]
            assert got.get(i, []) == at


# ---------------------------------------------------------------- 2


def test_cut_in_small_shards():
    import pyarrow as pa

    texts = [None, "ab " * 300_000, "a bé c " * 20, "x y z " * 150_000, ""] * 2
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts, "n_chars": [len(t or "") for t in texts]})
    found = [s for _, s in decontam.shards(iter([batch]), "doc_id", "text")]
    assert [i for s in found for i in s.ids] == list(range(10))
    assert max(s.n for s in found) < 500_000  # a worker's memory goes with the words of its shard
    # rows of a shard in the middle of a batch: one changed, one gone, the others as they were
    scanned = [(2, 60, 2, ["i"], [(2, 7)]), (3, 450_000, 0, [], []), (4, 0, 0, [], []), (5, 0, 0, [], []), (6, 300_000, 300_000, ["i"], [(0, 5)])]
    got = decontam._cut_rows(batch.slice(2, 5), scanned).to_pylist()
    first = b" ".join([texts[2].encode()[:2], texts[2].encode()[7:]]).decode()
    assert got[0] == {"doc_id": 2, "text": first, "n_chars": len(first)}
    assert got[1:] == batch.slice(3, 3).to_pylist()


def test_lines(spark, docs, empty):
    rows = [(5, "same line of text number one here\nother line\n\nsame line of text number one here"), (2, "same line of text number one here\nunique"), (9, None), (None, "null id line\nother line"), (7, ""), (7, "other line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_kept, r.kept_text) for r in lines.keep_lines(df).collect()), key=repr)
    assert sum(r[2] for r in got) == 4 and (9, 0, 0, None) in got and (7, 0, 0, "") in got
    unique = lines.keep_lines(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept_text) for r in unique} == {(2, "same line of text number one here\nunique"), (5, "other line\n"), (9, None)}
    base = "the quick brown fox jumps over the lazy dog while seven other animals look on from the old wooden fence near the river bank and the great hills beyond the town that nobody ever visits in the winter months of the year because snow covers every single road"
    near = spark.createDataFrame([(1, base), (2, base.replace("seven", "eight")), (3, "nothing like the others at all, really nothing")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in lines.keep_lines(near).collect()} == {1: 1, 2: 0, 3: 1}
    assert lines.keep_lines(empty).count() == 0 and lines.keep_lines(docs).count() == docs.count()


def brute_kept(texts):
    """Lines that brute force keeps of [text, ...] with one line each: components of Jaccard 0.8 over whole lines' 5-grams."""
    sets = [{t.lower()[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x] = up[up[x]]
        return x

    for j in range(len(sets)):
        for i in range(j):
            n = len(sets[i]) + len(sets[j])
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and root(i) != root(j) and 9 * len(sets[i] & sets[j]) >= 4 * n:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in up if root(i) == i}


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in lines.keep_lines(df).collect() if r.n_kept}


def test_lines_whole(spark):
    r = random.Random(4)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x5000)) for _ in range(n))
    head = han(14)
    texts = ["https://www.example.com/a/first-page", "https://www.example.com/zzz/other", head + han(20), head + han(20), "a\tb\tc\td\te\tf\tg\t1\t2\t3", "a\tb\tc\td\te\tf\tg\tx\ty\tz", "Abc", "aBC", "abd"]
    word = "".join(r.choice("abcdefghij") for _ in range(200))
    texts += ["start " + word, "start " + word[:20] + word[:19:-1], "START " + word.upper() + "x", "one long tail of a line " + word[:60], "one long tail of a line " + word[100:160]]
    words = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(4, 60))) for _ in range(150)]
    texts += words + [w[:-3] + "xyz" for w in words] + [w.replace(w.split()[2], "other", 1) for w in words]
    assert kept_ids(spark, texts) == brute_kept(texts)


def test_lines_large_group(spark):
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    # 2,400 different lines of one template, of Jaccard about 0.75; every line has one partner of about 0.83
    template = some(150)
    heads = [some(8) for _ in range(1200)]
    texts = [template + h + some(16) for h in heads * 2]
    r.shuffle(texts)
    want = brute_kept(texts)
    assert 1150 < len(want) < 1250 and kept_ids(spark, texts) == want


# ---------------------------------------------------------------- 3


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens(spark, docs, empty, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PART_MB", 0.002)
    tok = Tokenizer.from_file(tokenizer)
    start = 0
    want = []
    for d, t, *_ in corpus():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in tokens.round_trip(docs, tokenizer).collect())
    assert got == want
    assert tokens.round_trip(empty, tokenizer).count() == 0
    again = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c d"), (1, "b")], "doc_id long, text string")
    rows = tokens.round_trip(again, tokenizer).collect()
    assert sorted((r.doc_id is None, r.start) for r in rows)[-1] == (True, 0) and sum(r.n_tokens for r in rows) == 9


def test_dac():
    r = np.random.default_rng(5)
    for top in (2, 200, 60_000, 1 << 31):
        ids = r.integers(0, top, 3000).astype(np.uint32)
        f = tokens.DacFile(tokens.dac_bytes(np.array([1, 2]), np.array([0, 10, 3000]), ids))
        assert (f.all() == ids).all() and all(f.get(int(i)) == ids[i] for i in r.integers(0, 3000, 200))
    empty = tokens.DacFile(tokens.dac_bytes(np.zeros(0, np.int64), np.array([0]), np.zeros(0, np.uint32)))
    assert len(empty) == 0 and len(empty.all()) == 0
    data = bytearray(tokens.dac_bytes(np.array([1]), np.array([0, 3]), np.array([1, 300, 70000], np.uint32)))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.DacFile(bytes(data))


def test_token_caches_go(tokenizer, tmp_path):
    import pyarrow as pa

    tokens.encoder(tokenizer).encode(["a few words"])
    rows = pa.table({"doc_id": [5, -2, 5], "wide": [False, True, False], "ids": [b"\x02\x00\x01\x00", b"\x01\x00\x01\x00\x01\x00\x00\x00", b"\x01\x00"]})
    out = tokens._write_part(str(tmp_path), 3, rows).to_pylist()[0]
    assert not tokens._encoders  # a worker that writes files no longer holds the words it encoded
    f = tokens.DacFile(open(out["path"], "rb").read())
    assert (out["part"], out["n_docs"], out["n_tokens"]) == (3, 3, 5) and f.doc_ids.tolist() == [-2, 5, 5]
    assert f.offsets.tolist() == [0, 2, 3, 5] and f.all().tolist() == [65537, 1, 1, 2, 1]


def test_encoder_pieces(tokenizer):
    e = tokens.Encoder(tokenizer)
    r = random.Random(2)
    odd = ["", "Don't we'll d'eau, l'été!!", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ΣΑΣ Σ.", "É é İ ǅ œuvre", "a b c\x1cd\x85e\x0bf", "日本語 テスト 123abc 4.5%", unicodedata.normalize("NFD", "été größe")]
    odd += ["".join(r.choice("aéß,.'% \ńΣσZ9<|>œ") for _ in range(30)) for _ in range(500)]
    for t in odd:
        assert e.encode([t])[0].tolist() == e.tok.encode(t, add_special_tokens=False).ids, t


def test_encoder_learns_a_piece_once(tokenizer, monkeypatch):
    """A quarter of a million different words over many batches: none is encoded again while the cache can hold it."""
    letters = "abcdefgh"
    words = ["".join(letters[n >> 3 * k & 7] for k in range(6)) for n in range(1 << 18)]
    texts = [" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]
    enc, learned = tokens.Encoder(tokenizer), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: learned.extend(new) or learn(new))
    once = [enc.encode_bytes(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    again = [enc.encode_bytes(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    assert once == again and sorted(learned) == sorted(words)
    assert [x.tolist() for x in enc.encode(texts[:9])] == [e.ids for e in enc.tok.encode_batch(texts[:9], add_special_tokens=False)]


# ---------------------------------------------------------------- 4


def test_substrings(spark, docs, empty):
    for length, gram in ((40, 10), (400, 100)):
        rows = [(d, (t or "").encode()) for d, t, *_ in corpus()]
        seen = defaultdict(int)
        for _, b in rows:
            for i in range(len(b) - length + 1):
                seen[b[i : i + length]] += 1
        want = {}
        for d, b in rows:
            gone = bytearray(len(b))
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(x for x, g in zip(b, gone) if not g)
            want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(docs, length, gram).collect()}
        assert got == want and any(v[1] for v in want.values())
    same = spark.createDataFrame([(1, "a" * 900), (1, "b" * 399), (None, "ab" * 300), (None, "ab" * 300), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.removed(same).collect()) == [0, 0, 600, 600, 900]
    assert substrings.removed(empty).count() == 0


def test_two_stage():
    r = random.Random(4)
    for t in range(150):
        length = r.randint(1, 6)
        sl = [bytes(r.choice(b"ab" if t % 2 else b"abcd") for _ in range(r.randint(length, 14))) for _ in range(r.randint(1, 6))]
        lasts = [len(s) - length for s in sl]
        who, off, same = substrings.two_stage(sl, lasts, length)
        want = sorted(s[o : o + length] for s, z in zip(sl, lasts) for o in range(z + 1))
        assert [sl[w][o : o + length] for w, o in zip(who, off)] == want
        assert same.tolist() == [i > 0 and want[i] == want[i - 1] for i in range(len(want))]


# ---------------------------------------------------------------- 5


def test_mixing(spark, docs, empty):
    big = spark.range(0, 20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "big").when(F.col("id") % 10 == 9, "small").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(big, {"big": 1, "small": 1}).groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 10_000) < 500
    one = mixing.mix(big, {"small": 1.0})
    assert one.select("source").distinct().count() == 1 and sorted(map(tuple, one.collect())) == sorted(map(tuple, mixing.mix(big.repartition(9), {"small": 1.0}).collect()))
    out = mixing.mix(docs)
    assert set(docs.columns) <= set(out.columns) and {r.source for r in out.select("source").distinct().collect()} == {None, "s0", "s1", "s2"}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, {}).count() == 0


@pytest.mark.parametrize("n", [120, 75, 30])
def test_mixing_high_rates(spark, n):
    big = spark.range(0, 60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "small").otherwise("big").alias("source"))
    got = {r.doc_id: r["count"] for r in mixing.mix(big, {"small": 1}).groupBy("doc_id").count().collect()}
    rate = 60_000 / n  # 500, 800 and 2,000

    def count(i):
        u, total, k = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52), 0.0, 0
        while (total := total + math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))) <= u:
            k += 1
        return k

    assert got == {i: count(i) for i in range(n)}


# ---------------------------------------------------------------- 6


def brute_components(rows, k=5):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard(spark, docs, empty):
    want = brute_components([(d, t) for d, t, *_ in corpus()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.links(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    nulls = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.links(nulls).collect()), key=repr) == [(3, 3), (4, 3), (None, None)]
    assert jaccard.links(empty).count() == 0


def test_jaccard_near_the_bound(spark):
    """Many pairs around 0.8, in chains, so that a missed block or bound would show."""
    r = random.Random(8)
    rows = []
    for g in range(25):
        n = r.choice([6, 9, 12, 25, 60, 140, 300])
        base = [f"w{g}_{i}" for i in range(n)]
        for v in range(5):
            w = list(base)
            for _ in range(r.choice([0, 1, max(1, n // 90), max(1, n // 45), max(1, n // 40)])):
                w[r.randrange(len(w))] = f"e{g}_{v}_{r.randrange(10**6)}"
            if r.random() < 0.4:
                w = w[: len(w) - r.randrange(0, max(1, n // 5))]
            base = w if r.random() < 0.5 else base
            rows.append((len(rows), " ".join(w)))
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_jaccard_group_of_near_copies_takes_pairs_in_proportion(spark, monkeypatch):
    """Copies of one text, each with its own words at some places: few link with the first, nearly all with some other, and no pair twice."""
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in range(200)]
        for k in r.sample(range(12), 3):
            w[k * 16] = f"e{k}_{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    counted = []
    count = jaccard.count_overlaps
    monkeypatch.setattr(jaccard, "count_overlaps", lambda pairs, sets, pruned=False: counted.append(pairs.count()) or count(pairs, sets, pruned))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and sum(counted) <= 5 * len(rows), counted


def test_jaccard_later_rounds_take_only_documents_that_may_link(spark, monkeypatch):
    """Documents that share blocks and do not link are held against each other once; near copies in their lists still grow together."""
    r = random.Random(12)
    shared = [f"s{k}" for k in range(60)]
    rows = [(i, " ".join(shared + [f"o{i}_{k}" for k in range(60)])) for i in range(300)]
    for i in range(300, 340):
        w = shared + [f"t{k}" for k in range(60)]
        for k in r.sample(range(12), 2):
            w[60 + k * 5] = f"e{k}_{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    seen, opened = [], jaccard._open
    monkeypatch.setattr(jaccard, "_open", lambda entries, comp, tag: seen.append(entries.select("doc").distinct().count()) or opened(entries, comp, tag))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and len(seen) > 1 and seen[0] > 300 and max(seen[1:]) <= 40, seen


def test_jaccard_tiles(monkeypatch):
    """Pairs of lists of many sizes, each once, also where a list takes several tiles."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 20)
    size = np.array([1, 2, 9, 2, 4, 5, 13, 1])
    first = np.cumsum(size) - size
    got = [x for r, c in jaccard._pairs_of(first, size) for x in zip(r.tolist(), c.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(f + i, f + j) for f, n in zip(first.tolist(), size.tolist(), strict=True) for j in range(n) for i in range(j)}


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 7


def test_media(spark):
    v = spark.createDataFrame([(i, [float((i * 31 + k * 17) % 23) for k in range(8)]) for i in range(40)] + [(100, None), (101, [0.0, 17.0, 11.0, 5.0, 22.0, 16.0, 10.0, 4.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    m = media.render_media(v)
    got = {r.media_id: r.component_id for r in media.copies(m).collect()}
    copies = [i for i in got if i is not None and i >= media.COPY_ID]
    groups = defaultdict(set)
    for i, c in got.items():
        groups[c].add(i)
    assert len(copies) == 4 and all(got[i] == got[i - media.COPY_ID] for i in copies if i - media.COPY_ID in got)
    assert got[100] == 100 and got[101] == got[0] and got[None] is None
    assert all(len({i % media.COPY_ID for i in g} - {101, 23 + 0}) <= 2 for g in groups.values() if None not in g)
    assert media.copies(m.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_quality(spark, sf_dir, empty):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.scores(d, lab).collect()
    gold = {r.doc_id: r.quality for r in lab.collect()}
    held = [(r.predicted, gold[r.doc_id]) for r in rows if r.held_out and r.doc_id in gold]
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows) and sum(p == g for p, g in held) / len(held) > 0.85
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    # labels of held-out rows change nothing
    flipped = lab.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scores(d, flipped).collect()} == {r.doc_id: r.score for r in rows}
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "word " * 5000)], "doc_id long, text string").withColumn("label", F.lit(1))
    assert {r.score for r in quality.scores(odd, lab.limit(0)).collect()} == {0.5}
    assert quality.scores(odd, lab.union(lab)).count() == 4 and quality.scores(empty, lab).count() == 0
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 1}


# ---------------------------------------------------------------- 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(text):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]()

    return sorted((m.start(), i, k, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if ok(k, m.group()))


def test_personal_data(spark, empty):
    r = random.Random(7)
    texts = ["mail a.b@c.de or x@y.z_q@r.st, ünï@x.org😀 then d@e.fg", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111", "call +1 (555) 123-4567 or +12 345", None, "", "9" * 30_000, "a" * 30_000 + "@b.cd", "1 " * 8000, "reach me: bob [at] mail [dot] com or (555) 123-4567"]
    texts += ["".join(r.choice("ab.@+-_ 0123456789()é\n") for _ in range(200)) for _ in range(150)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    got = sorted(((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in pii.find(df).collect()), key=repr)
    want = []
    for i, t in rows:
        s = base_spans(t)
        want.append((i, *(sum(x[2] == k for x in s) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in s).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    for x in pii.find(df.filter("doc_id is not null")).collect():
        s = base_spans(texts[x.doc_id])
        assert {f"{k}:{a}:{z}" for a, _, k, z in s} <= set(x.spans.split(","))
    assert pii.find(empty).count() == 0


def test_expectation_maximisation():
    r = random.Random(9)
    counts = defaultdict(int)
    for _ in range(5000):
        z = r.random() < 0.4
        counts[tuple(int(r.random() < p) for p in ((0.9, 0.8, 0.85) if z else (0.1, 0.2, 0.05)))] += 1
    prior, yes, no, post = pii.expectation_maximisation(sorted(counts.items()))
    assert abs(prior - 0.4) < 0.05 and yes == pytest.approx([0.9, 0.8, 0.85], abs=0.05) and post[(1, 1, 1)] > 0.95 > 0.05 > post[(0, 0, 0)]


# ---------------------------------------------------------------- 10


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (5, "u2", big), (3, None, big), (None, "u", big), (2, "u", "x"), (4, "u", "x"), (6, "u", None), (7, "u\r\nv", ""), (8, "u", "y" * 200_000), (5, "u2", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i in (1, 3)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader():
    payload = b"<html>\r\n\r\nWARC/1.1\r\n</html>"
    raw = [warc.build_record("urn:page:1", "http://a", payload), warc.build_record("urn:page:2", "http://b", b"")]
    data = b"".join(warc.gzip_member(x) for x in raw)
    assert [r["payload"] for r in warc.read_warc(io.BytesIO(data))] == [payload, b""]
    for n in (1, 7):
        assert len(list(warc.gzip_members(io.BytesIO(data), n))) == 2
    assert base64.b32decode(warc.sha1_base32(payload)[5:]) == hashlib.sha1(payload).digest()
    bad = [raw[0].replace(b"<html>", b"<htmx>"), raw[0][:-1], raw[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), b"no record"]
    for x in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_warc(io.BytesIO(warc.gzip_member(x))))
    with pytest.raises(warc.WarcError):
        list(warc.read_warc(io.BytesIO(data[:-5])))


# ---------------------------------------------------------------- all


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = d
    for name, stage in p.STAGES[:-1]:
        before = out.count()
        out = stage(spark, out, sf_dir)
        assert out.columns == list(p.COLUMNS), name
        assert name == "mixing" or out.count() <= before
    rows = p.run(spark, sf_dir).collect()
    ids = sorted(rows, key=lambda r: r.start)
    assert ids[0].start == 0 and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(ids, ids[1:]))


def test_queries_match_sql(spark, sf_dir):
    from compare import spark_rows, sql_rows

    from loomspark.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(sql, sf_dir), name
