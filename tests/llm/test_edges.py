"""More cases of the training-data operators: groups of edited pictures, added personal data, odd rows in every stage of the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import WORDS, base_spans, brute_components, brute_kept, kept_ids, luhn

from loomspark.llm import lines, media, mixing, pii, quality, substrings

# ---------------------------------------------------------------- 2


def test_lines_odd_rows(spark):
    long = "\n".join(["the same long line of the text, over and over again"] * 30_000 + [f"a line of its own {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(2000)])
    rows = [(3, long), (1, "the same long line of the text, over and over again\n\n  \nabc"), (2, ""), (4, None), (5, "ABC"), (6, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS node", "'k' AS key", "0 AS line_no", "doc_id AS doc", "text AS line")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.kept_text) for r in lines.keep_lines(df).collect()}
    assert got[1] == (2, 2, rows[1][1]) and got[2] == (0, 0, "") and got[4] == (0, 0, None) and got[5] == (1, 0, "") and got[6] == (1, 1, "x" * 200_000)
    assert got[3] == (32_000, 2000, "\n".join(long.split("\n")[30_000:]))


def test_lines_by_phrases(spark, monkeypatch):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))

    def edited(text, share):
        """One character in so many changed, at even distances: as few phrases as can be stay."""
        step = max(1, int(1 / share))
        return "".join("z" if i % step == step // 2 else c for i, c in enumerate(text))

    rows, put = [], lines.materialize

    def kept_by(df, tag):
        out = put(df, tag)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(lines, "materialize", kept_by)
    texts = [line(r.randrange(20, 120)) for _ in range(120)]
    texts += [edited(t, s) for t in texts for s in (1 / 70, 1 / 50, 1 / 46, 1 / 30)]
    assert kept_ids(spark, texts) == brute_kept(texts)
    # ordinary lines are not cut into all their 5-character strings to find their partners
    assert dict(rows)["line-bins"] == 0
    # a passage that unlike lines share, with a partner each, two kinds of words only, short ones, and lists of numbers
    passage = line(25)
    own = [line(25) for _ in range(90)]
    texts = [passage + " " + o for o in own] + [passage + " " + edited(o, 1 / 50) for o in own]
    texts += [" ".join(r.choice(("yes", "not")) for _ in range(n)) for n in (100, 120, 300)] + [line(4) for _ in range(20)]
    texts += [" ".join(str(r.randrange(100)) for _ in range(60)) for _ in range(10)]
    texts += [t[:-1] + "q" for t in texts[-30:]]
    assert kept_ids(spark, texts) == brute_kept(texts)
    assert dict(rows)["line-unsettled"] > 0


# ---------------------------------------------------------------- 4


def test_shorter_repeats(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, head = some(300), some(450)
    texts = [some(500) + passage + some(90), passage + some(10), some(300) + passage, head + some(40), some(20) + head, some(239), some(700), passage[:239] + some(300)]
    size = 240
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    want = {}
    for d, b in enumerate(raw):
        on = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                on[i : i + size] = b"\1" * size
        want[d] = sum(on)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_repeated, x.n_removed) for x in substrings.removed(df).collect()}
    assert {d: n for d, (n, _) in got.items()} == want and got[0][1] == 0 and got[3][1] >= 450 and sum(want.values()) > 1500


# ---------------------------------------------------------------- 7


def pictures(n, seed):
    r = np.random.default_rng(seed)
    return [media.draw(r.normal(size=8).astype(np.float32)) for _ in range(n)]


def test_media_edits_and_groups(spark):
    base = pictures(18, 3)
    rows = [(i, p) for i, p in enumerate(base)]
    rows += [(1000 + 10 * i + k, media.edit(p, k)) for i, p in enumerate(base) for k in range(media.KINDS)]
    rng = np.random.default_rng(8)
    one = pictures(1, 99)[0]
    group = [(5000 + i, media.edit(np.clip(one.astype(np.float32) * rng.uniform(0.8, 1.1) + rng.normal(0, 4, one.shape), 0, 255).astype(np.uint8)[rng.integers(0, 8) :, rng.integers(0, 8) :], 3)) for i in range(60)]
    rows += group
    flat = np.full((64, 64), 80, np.uint8)
    rows += [(7000, flat), (7001, flat + 1), (7002, one[:3, :3])]
    df = spark.createDataFrame([(i, *p.shape, bytearray(np.ascontiguousarray(p).tobytes())) for i, p in rows] + [(8000, 4, 4, None), (None, 64, 64, bytearray(one.tobytes())), (8001, 9, 9, bytearray(b"x"))], media.MEDIA)
    df = df.selectExpr("*", "1 AS n", "2 AS a", "3 AS b", "'x' AS digest", "0 AS component").repartition(6)
    got = {r.media_id: r.component_id for r in media.copies(df).collect()}
    found = [(k, got[1000 + 10 * i + k] == got[i]) for i in range(len(base)) for k in range(media.KINDS)]
    assert sum(x for k, x in found if k < 8) >= 0.95 * sum(k < 8 for k, _ in found) and sum(x for _, x in found) >= 0.9 * len(found)
    assert Counter(got[i] for i, _ in group).most_common(1)[0][1] >= 54
    truth = lambda i: ("g",) if 5000 <= i < 5060 else (i if i < 1000 else (i - 1000) // 10 if i < 5000 else -i,)
    by = defaultdict(set)
    for i, c in got.items():
        if i is not None:
            by[c].add(truth(i))
    assert all(len(x) == 1 for x in by.values()) and got[8000] == 8000 and got[None] is None and got[7000] == 7000


# ---------------------------------------------------------------- 8


def test_pooled_features():
    r = random.Random(6)
    texts = [" ".join(r.choice(WORDS + ["!!", "A1", "LOUD", "loud loud", "été"]) for _ in range(r.randrange(0, 60))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    v = np.random.default_rng(1).normal(size=(quality.ROWS, quality.DIMS)).astype(np.float32)
    x = quality.pool(data, offs, v)
    for k, b in enumerate(raw):
        own = np.frombuffer(b, np.uint8)
        t, _, kind = quality.tokens_of(own, np.array([0, len(b)], np.int64))
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r]+", b)
        assert len(t) == len(words)
        mean = sum((v[i] for i in t), np.zeros(quality.DIMS)) / (len(t) + quality.FEW)
        assert np.allclose(x[k, : quality.DIMS], mean, atol=1e-4)
        assert np.allclose(x[k, quality.DIMS : quality.DIMS + 4], [sum(kind == c) / (len(t) + quality.FEW) if len(t) else 0 for c in range(4)], atol=1e-5)


# ---------------------------------------------------------------- 9


def test_added_spans(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        while not luhn(x := "4" + digits(15)):
            pass
        return x

    good = {
        "email": lambda: f"{word()} [at] {word()} [dot] com",
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "card": lambda: ".".join(re.findall("....", card())),
        "secret": lambda: r.choice([f"password={digits(3)}a{word()}{digits(4)}", f'token = "{hashlib.md5(word().encode()).hexdigest()}"', "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQ23456789") for _ in range(15)) + "7"]),
    }
    cue = {"email": "write to", "phone": "call", "card": "visa", "secret": "login"}
    bad = [lambda: f"{digits(3)}-{digits(3)}-{digits(5)}x", lambda: f"{word()} [at] {word()}", lambda: word() * 6, lambda: f"key: {word()}", lambda: f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(1)}x", lambda: f"section {digits(1)}.{digits(1)}"]
    rows, want = [], set()
    for i in range(600):
        before = " ".join(word() for _ in range(6))
        if i % 2:
            kind = r.choice(list(good))
            lead = before + " " + (cue[kind] + " " if r.random() < 0.8 else "")
            span = good[kind]()
            rows.append((i, lead + span + " " + word()))
            want.add((i, kind, len(lead), len(lead) + len(span)))
        else:
            rows.append((i, before + " " + r.choice(bad)() + " " + word()))
    rows += [(700 + i, f"{word()} {word()}{i}@mail.example.com {word()} 10.0.{i}.7") for i in range(40)]
    got = set()
    for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = {(k, a, z) for a, _, k, z in base_spans(dict(rows)[x.doc_id])}
        spans = {(k, int(a), int(z)) for k, a, z in (s.split(":") for s in x.spans.split(",") if s)}
        assert base <= spans and x.n_spans == len(spans)
        got |= {(x.doc_id, *s) for s in spans - base}
    hit = len(got & want)
    print("added spans: precision", hit / max(1, len(got)), "recall", hit / len(want), Counter(k for _, k, _, _ in got - want), Counter(k for _, k, _, _ in want - got))
    assert hit >= 0.9 * len(got) and hit >= 0.75 * len(want)


# ---------------------------------------------------------------- the pipeline


def stage_rows():
    r = random.Random(2)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(80)) for _ in range(k))
    item = text(14)
    out = [text(r.randrange(5, 60)) for _ in range(40)]
    out += [out[1], out[1], out[2] + " tail", "start " + item + " end " + text(8), item, None, "", " \n", "word", text(5000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 8 else None, None if t is None else len(t)) for i, t in enumerate(out)]
    return [*rows, (None, text(30), None, "s1", 5), (7, text(12), "fr", "s2", 6), (7, rows[7][1], "en", "s1", 6)], item


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    _, item = stage_rows()
    pq.write_table(pa.table({"doc_id": pa.array([0, 1, 2, 3, 3, None], pa.int64()), "quality": pa.array([1, 1, 1, 1, None, 0], pa.int32()), "toxic": pa.array([0] * 6, pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, None], pa.int64()), "text": pa.array([item, "", None], pa.string())}), d / "benchmark.parquet")
    return str(d)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS component_id", "2 AS score", "'z' AS copy", "3 AS n", "4 AS a").repartition(3)


def test_stages_with_odd_rows(spark, small_dir):
    import corpus_pipeline as p

    stages, (rows, item) = dict(p.STAGES), stage_rows()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    key = lambda xs: sorted((tuple(x) for x in xs), key=repr)
    for name, stage in stages.items():
        none = stage(spark, frame(spark, []), small_dir)
        assert none.count() == 0 and (name == "tokens" or none.columns == names), name
    # one class of labels only: every score is its share, 1.0, and nothing goes
    assert key(stages["quality"](spark, frame(spark, rows), small_dir).collect()) == key(rows)

    # near duplicates: rows of ids that are not the smallest of their component go, rows without an id stay
    kept = stages["near_duplicates"](spark, frame(spark, rows), small_dir).collect()
    plain = [(d, t) for d, t, *_ in rows if d is not None and d != 7]
    comp = brute_components(plain)
    assert key(x for x in kept if x.doc_id is not None and x.doc_id != 7) == key(x for x in rows if x[0] is not None and x[0] != 7 and comp[x[0]][1] == x[0])
    assert sum(x.doc_id is None for x in kept) == 1 and sum(x.doc_id == 7 for x in kept) == 3

    cut = stages["decontamination"](spark, frame(spark, rows), small_dir).collect()
    assert not any(item in (x.text or "") for x in cut) and all(x.n_chars == len(x.text) for x in cut if x.doc_id == 43)
    assert key(x for x in cut if x.doc_id not in (43, 44)) == key(x for x in rows if x[0] not in (43, 44)) and all(x.doc_id != 44 for x in cut)

    mixed = Counter(tuple(x) for x in stages["mixing"](spark, frame(spark, rows), small_dir).collect())
    sizes = Counter(x[3] for x in rows)
    weights = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    want = Counter()
    for x in rows:
        rate = weights[x[3]] / sum(weights.values()) * len(rows) / sizes[x[3]]
        u, total, k = int(hashlib.md5(f"{mixing.SEED}:{'null' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) / (1 << 52), 0.0, 0
        while (total := total + math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))) <= u:
            k += 1
        if k:
            want[x] += k
    assert mixed == want

    tokenizers, vocabulary = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    enc = tokenizers.Tokenizer.from_file(vocabulary.path("word_bpe_49k.json"))
    whole = [x for x in rows if x[0] is not None and x[0] != 7]
    got = {x.doc_id: x for x in stages["tokens"](spark, frame(spark, whole), small_dir).collect()}
    at = 0
    for d, t, *_ in sorted(whole):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
