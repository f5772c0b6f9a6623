"""The operators against brute force, on texts with nulls, empties, repeats, ties and clashing column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import bpe, exact_dedup, line_dedup, near_dedup, packing, pii, quality, sharding, tokens, topk
from orrery.llm.shared import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, level int, key string, n_chars long"
random.seed(7)
PROSE = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 13) for i in range(400))
TEXTS = [PROSE, PROSE, None, "", "   ", "mail a.b@c.org or _x@y.com_z@w.com, call +1 (743) 555-3824; 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111", "é漢😀 <|endoftext|> x  y\n\n z", "word " * 6000,
         PROSE.replace("alpha3", "omega"), "one line here that is long enough\nother\nthird line that has more words", "fresh start of text\none line here that is long enough\nthird line that has more words", "1" * 5000, "a@" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 5) for i, t in enumerate(TEXTS)] + [(0, PROSE, 1, "k", 5), (None, "no id", 1, "k", 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact(spark, docs, none):
    by = defaultdict(list)
    for d, t in _texts(docs):
        by[t].append(d)
    want = sorted((str(d), str(max(x for x in g)) if None not in g else "None", len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for d in g)
    got = exact_dedup.dedup_exact(spark, docs, block_bytes=16).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.dedup_exact(spark, none).count() == 0


def test_sharding(spark, docs, none):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    got = sharding.shard_rows(docs, 7).collect()
    for r in got:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 7), jump(key, 8)) and r.grown_shard in (r.shard, 7)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in _texts(docs))
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(none).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def _base(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if _valid(k, m[0]))


def test_pii(spark, docs, none):
    got = pii.report(spark, docs).collect()
    want = sorted(hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in _base(t)).encode()).hexdigest() for _, t in _texts(docs))
    assert sorted(r.base_sha256 for r in got) == want
    clean = pii.redact(spark, docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(_base(t) for _, t in _texts(clean))
    assert pii.report(spark, none).count() == 0 == pii.redact(spark, none).count()


def test_pii_discovers(spark):
    rows = [(i, f"so my badge number user{i}@mail.example.org was lost") for i in range(9)] + [(9, "so badge number zx81-q was lost")]
    got = {r.doc_id: r for r in pii.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9].spans == "email:16:22" and got[9].n_email == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)]
    rows += [(200, None), (201, [1.0, None] * 4), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [1.0] * 3), (None, [1.0] * 8), (5, [0.5] * 8), (206, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, topk.top_k(spark, df, df.filter("vec_id % 10 = 0"), 5, block=4).collect()))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 10 == 0:
            s = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    assert got == sorted(want)
    assert topk.top_k(spark, df.limit(0), df.limit(0)).count() == 0


def test_bpe_and_counts(spark, docs, none):
    library, rows = Tokenizer.from_file(BYTE), _texts(docs)
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BYTE).collect()) == want
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()) == sorted(t for _, t in rows)
    cache = Scratch(spark, "test").path("cache")
    for _ in range(2):  # the second time from the cache
        got = tokens.count_tokens(spark, docs, BYTE, cache).collect()
        assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len(t.encode()), len(i), len(i) > 1024) for (_, t), i in zip(rows, ids, strict=True))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t for _, t in rows})
    assert bpe.round_trip(none, BYTE).count() == 0 == tokens.count_tokens(spark, none, BYTE, cache).count()


def test_bpe_random():
    library, own, cut = Tokenizer.from_file(BYTE), bpe.codec(BYTE), bpe.Chunks(bpe.codec(BYTE), 50)
    parts = ["a", "b", "aa", " ", "  ", "\n", "\x1c", "\xa0", "'s", "'", "é", "漢", "\U0001f600", "1", "٣", "!", "--", "the", "ing", "<|endoftext|>", "​", "　", "\x85"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids == cut(text).tolist() and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_packing(spark, docs, none):
    library, rows = Tokenizer.from_file(WORD), _texts(docs)
    got = packing.pack(spark, docs, WORD, capacity=512, keep_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert sum(r.length for r in got) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packing.pack(spark, none, WORD).count() == 0


def test_differencing():
    for _ in range(50):
        sizes = [random.randint(1, 90) for _ in range(random.randint(1, 60))]
        found = packing.windows_of(sizes, 100)
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 100 for w in found)


def test_quality(spark, docs, none):
    good = [f"the plain words of text number {i} are calm and varied" for i in range(150)]
    bad = ["BUY!! NOW!! " * (3 + i % 5) for i in range(50)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"))
    model = quality.train(d, labels)
    got = quality.score(spark, d, model).collect()
    assert all(r.predicted == (r.doc_id < 150) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.score(spark, docs, model).count() == docs.count() and quality.score(spark, none, model).count() == 0
    assert quality.keep_good(spark, d, model).count() == 150
    assert quality.train(none, labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_lines(spark, docs, none):
    got = line_dedup.dedup_lines(spark, docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[0] == PROSE and by[1] == "" and by[2] is None and by[10] == "fresh start of text"
    assert line_dedup.dedup_lines(spark, none).count() == 0
    many = spark.createDataFrame([(i, f"a frequent line of many words\nown words of document {i} here") for i in range(9)], "doc_id long, text string")
    kept = [r.text.split("\n")[0] for r in line_dedup.dedup_lines(spark, many).collect()]
    assert sum(x == "a frequent line of many words" for x in kept) == 1


def test_alignment():
    for _ in range(300):
        a, b = ([random.choice("abcdefg") for _ in range(random.randint(0, 12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_edit_similarity():
    for _ in range(500):
        a = [random.choice("xyzw") for _ in range(random.randint(0, 30))]
        b = a[:]
        for _ in range(random.randint(0, 7)):
            k = random.randint(0, len(b))
            b = random.choice([b[:k] + b[k + 1:], [*b[:k], random.choice("xyzw"), *b[k:]], [*b[:k], "q", *b[k + 1:]]])
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        want = 1 - row[-1] / max(1, len(a), len(b))
        assert abs(near_dedup.edit_similarity(a, b) - (want if want >= 0.8 - 1e-9 else 0)) < 1e-9


def test_near(spark, docs, none):
    got = near_dedup.near_duplicates(spark, docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id): r for r in got}
    assert by[0].class_id == by[1].class_id == by[8].class_id == 0 and by[0].class_size == 4 and by[2].class_id == by[3].class_id == 2
    assert by[5].class_size == 1 and sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got})
    kept = near_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert near_dedup.near_duplicates(spark, none).count() == 0


def _scattered(rng, text, n):
    """``text`` with ``n`` of its words changed, spread evenly."""
    at = {int((i + 0.5) * len(text) / n) for i in range(n)}
    return [f"new{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(text)]


def test_near_hot_buckets(spark):
    """Near copies that share a few tuples only, among unlike texts that share a passage with them."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(20)]
    texts = [passage + [f"u{rng.randrange(10**9)}" for _ in range(80)] for _ in range(60)]
    for _ in range(30):
        own = [f"w{rng.randrange(10**9)}" for _ in range(80)]
        texts += [passage + own, passage + _scattered(rng, own, 18)]
    sketches = [near_dedup.sketch(near_dedup.kmers(near_dedup._Hashes().of(t))) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (sketches[i] == sketches[j]).any() and near_dedup.edit_similarity(texts[i], texts[j]) >= 0.8]
    assert sum((sketches[i] == sketches[j]).sum() <= 3 for i, j in pairs) >= 5
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    by = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark, docs).collect()}
    root = list(range(len(texts)))
    for i, j in sorted(pairs):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert [by[i] for i in range(len(texts))] == root


def test_lines_short(spark):
    """A passage of short and blank lines goes from every later document, however many hold it."""
    lines = "".join(f"\n{x} of passage" if i % 4 else "\n" for i, x in enumerate("abcdefghijkl"))
    for n in (9, 60):
        docs = spark.createDataFrame([(i, f"own words of document number {i}{lines}") for i in range(n)] + [(n + i, f"\none two{lines}\n\nend") for i in range(n)], "doc_id long, text string")
        by = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs).collect()}
        assert by[0] == f"own words of document number 0{lines}" and by[n] == "\none two\n\nend"
        assert all(by[i] == f"own words of document number {i}" for i in range(1, n)) and all(by[n + i] == "" for i in range(1, n))


def test_runs():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice((0, 0, 1, 2, 3, 6)) for _ in range(rng.randint(0, 14))]
        digests = [hashlib.md5(b"%d" % rng.randint(0, 3)).digest() for _ in words]
        parts = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        found = list(zip(*line_dedup.runs(parts, words, 5), strict=True))
        covered = {k for _, i, j in found for k in range(i, j)} | {i for i, w in enumerate(words) if w >= 5}
        assert all(sum(words[i:j]) >= 5 for _, i, j in found) and covered == (set(range(len(words))) if sum(words) >= 5 else set())
        assert all((x == y) == (digests[i:j] == digests[k:m]) for x, i, j in found for y, k, m in found)


def test_lines_linked_by_run(spark):
    """A block is found in the first document that holds it, though each of its lines is in an earlier one."""
    texts = ["one short line\nown words of the first", "own words of the second\ntwo short lines", "one short line\ntwo short lines\nown words of the third", "own words of the fourth\none short line\ntwo short lines"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs).collect()}
    assert [by[i] for i in range(4)] == [*texts[:3], "own words of the fourth"]


def _new_lines(texts):
    """What is left of each text, as lists of lines in order of age."""
    want = []
    for i, d in enumerate(texts):
        gone: set[int] = set()
        for e in texts[:i]:
            there = {tuple(e[p:q]) for p in range(len(e)) for q in range(p + 1, len(e) + 1)}
            for p in range(len(d)):
                for q in range(p + 1, len(d) + 1):
                    if sum(len(x.split()) for x in d[p:q]) >= 5 and tuple(d[p:q]) in there:
                        gone.update(range(p, q))
        want.append("\n".join(x for k, x in enumerate(d) if k not in gone))
    return want


def test_lines_brute_force(spark):
    """A line goes if and only if it lies in an unbroken run of five words or more that an earlier document holds; lines of one to six words, blank, moved and reversed ones."""
    rng = random.Random(9)
    stock = ["", "one", "two two", "a b c", "d e f g", "five words are in here", "x", "six words are in this line", "y z"]
    texts = [[rng.choice(stock) for _ in range(rng.randint(1, 12))] for _ in range(70)]
    texts += [list(reversed(t)) for t in texts[:10]] + [t[len(t) // 2:] + t[:len(t) // 2] for t in texts[10:20]]
    texts += [[f"own line {i}", *texts[3]] for i in range(70)]  # over any bound on holders
    want = _new_lines(texts)
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    by = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs).collect()}
    assert [by[i] for i in range(len(texts))] == want


def test_near_recall(spark):
    """Of planted pairs at each similarity, the share that the whole query joins."""
    rng, levels, n = random.Random(17), (0.80, 0.85, 0.90, 0.95), 60
    texts = []
    for s in levels:
        for _ in range(n):
            a = [f"w{rng.randrange(10**9)}" for _ in range(200)]
            b = a[:]
            for i in rng.sample(range(200), round((1 - s) * 200)):
                b[i] = f"v{rng.randrange(10**9)}"
            texts += [a, b]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    by = {r.doc_id: r for r in near_dedup.near_duplicates(spark, docs).collect()}
    assert all(near_dedup.edit_similarity(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2))
    recall = [sum(by[i].class_id == by[i + 1].class_id for i in range(2 * n * k, 2 * n * (k + 1), 2)) / n for k in range(len(levels))]
    assert all(r.class_size <= 2 for r in by.values()) and recall[0] > 0.8 and min(recall[1:]) > 0.95 and sum(recall) / 4 > 0.93, recall


def test_bits():
    for _ in range(200):
        a = [random.choice("abcdefgh") for _ in range(random.randint(1, 40))]
        b = [random.choice("abcdefgh") for _ in range(random.randint(1, 40))] if random.random() < 0.5 else [x if random.random() < 0.9 else "z" for x in a]
        x, y = (near_dedup.bits(near_dedup._Hashes().of(t)) for t in (a, b))
        alone = sum(int(v).bit_count() for v in (x & ~y).view(np.uint64))
        assert alone + max(0, len(b) - len(a)) <= near_dedup._banded(a, b, 100)


def test_uses():
    for _ in range(200):
        a = [random.choice("abcdefgh") for _ in range(random.randint(1, 40))]
        b = [random.choice("abcdefgh") for _ in range(random.randint(1, 40))] if random.random() < 0.5 else [x if random.random() < 0.9 else "z" for x in a]
        x, y = (set(near_dedup.uses(near_dedup._Hashes().of(t)).tolist()) for t in (a, b))
        assert len(x - y) + max(0, len(b) - len(a)) <= near_dedup._banded(a, b, 100)


def test_near_long_passage(spark, monkeypatch):
    """Long texts that share most of their words are refused in the join, unless their uses of words allow a link."""
    rng = random.Random(23)
    passage, own = ["is", "onhe"] * 290, lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = [own(60) + passage + own(110) for _ in range(40)]
    for t in texts[:5]:
        texts.append([w if w in ("is", "onhe") or i % 2 else f"v{rng.randrange(10**9)}" for i, w in enumerate(t)])
    count = len(texts)
    counted = [Counter(t) for t in texts]
    likely = sum((counted[i] - counted[j]).total() <= 0.2 * 750 + 10 for i in range(count) for j in range(i))
    linked = [(j, i) for i in range(count) for j in range(i) if near_dedup.edit_similarity(texts[i], texts[j]) >= 0.8]
    compared = {}

    class Counting(near_dedup.Scratch):
        def save(self, df, name):
            saved = super().save(df, name)
            compared[name] = saved.count() if name.endswith("-pairs") else None
            return saved

    monkeypatch.setattr(near_dedup, "Scratch", Counting)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    by = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark, docs).collect()}
    assert linked == [(i, 40 + i) for i in range(5)] and likely == 5
    assert compared["rest-pairs"] <= likely
    assert [by[i] for i in range(count)] == [*range(40), *range(5)]


def _discovered(texts, min_seeds=5, min_confidence=0.9, rounds=3):
    """The spans of ``pii``, worked out row by row: letter runs are cut at matches of the same kind."""
    space, letters = " \t-\r", regex.compile(r"\p{L}+")
    kinds = [*PLAIN.items(), ("token", rf"(?<![^{space}])[^{space}0-9@]*[0-9@][^{space}]*")]
    found = []
    for d, t in enumerate(texts):
        base = [(s, e) for s, _, e, _ in _base(t)]
        for k, p in kinds:
            words, last = [], 0  # (end, word)
            for m in re.finditer(p, t):
                words += [(last + x.end(), x[0].lower()) for x in letters.finditer(t[last:m.start()])]
                near = len(words) > 1 and re.fullmatch(rf"[{space},:;(]*", t[words[-1][0]:m.start()])
                context = f"{words[-2][1]} {words[-1][1]}" if near else ""
                words += [(m.start() + x.end(), x[0].lower()) for x in letters.finditer(m[0])]
                last = m.end()
                s, e = m.span()
                if k == "token":
                    s += len(m[0]) - len(m[0].lstrip("([{<\"'"))
                    e -= len(m[0]) - len(m[0].rstrip(")]}>\"'.,;:!?"))
                    if s >= e or any(x < e and s < y for x, y in base):
                        continue
                elif not _valid(k, m[0]):
                    continue
                found.append((d, k, s, e, context, t[s:e].lower()))
    graph = defaultdict(int)
    for _, k, _, _, c, x in found:
        if c:
            graph[c, x, k] += 1
    seeds = {(c, k) for c, _, k in graph if k != "token" and sum(key[2] == k for key, _ in graph_items(graph, c)) >= min_seeds}
    belief = {}
    for _ in range(rounds):
        conf = {}
        for c, k in seeds:
            edges = list(graph_items(graph, c))
            conf[c, k] = sum(n * (1.0 if k2 == k else belief.get((x, k), 0.0) if k2 == "token" else 0.0) for (_, x, k2), n in edges) / sum(n for _, n in edges)
        miss = defaultdict(lambda: 1.0)
        for c, k in seeds:
            for (_, x, k2), _ in graph_items(graph, c):
                if k2 == "token":
                    miss[x, k] *= 1 - min(conf[c, k], 0.999999)
        belief = {key: 1 - v for key, v in miss.items()}
    out = [[(s, list(PLAIN).index(k), e, k) for at, k, s, e, _, _ in found if at == d and k != "token"] for d in range(len(texts))]
    for d, k, s, e, c, x in found:
        if k == "token":
            of = [(v, kind) for (y, kind), v in belief.items() if y == x]
            if of and conf.get((c, max(of)[1]), 0) >= min_confidence:
                out[d].append((s, list(PLAIN).index(max(of)[1]), e, max(of)[1]))
    return [",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x)) for x in out]


def graph_items(graph, context):
    return ((key, n) for key, n in graph.items() if key[0] == context)


def test_pii_brute_force(spark):
    """Contexts over other matches and long white space; words before, far away; patterns of several kinds."""
    rng = random.Random(3)
    texts = []
    for i in range(160):
        what = rng.choice([f"user{i}@mail.example.org", f"10.0.{i}.7", "+1 (743) 555-3824", f"zx{i % 7}-q", "4111 1111 1111 1111", f"{i}"])
        before = rng.choice(["badge number", "badge 7 number", "my host", "Call Me", "see a@b.org now", "number"])
        texts.append(f"{rng.choice(['', 'so ', 'x 12 '])}{before}{rng.choice([' ', ': ', ' ' * 60, ' - ', ' ('])}{what}{rng.choice(['', '.', ', and 44 more'])}")
    texts += [f"badge number user{i}@m.example.org" for i in range(70)] + ["badge 7 number zx82-q", "badge number" + " " * 60 + "zx81-q", "", "badge number 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    by = {r.doc_id: r.spans for r in pii.report(spark, docs, min_confidence=0.6).collect()}
    want = _discovered(texts, min_confidence=0.6)
    assert [by[i] for i in range(len(texts))] == want
    assert by[len(texts) - 4] == "email:15:21" and by[len(texts) - 3].startswith("email:72:78")


def test_pipeline(spark, tmp_path):
    """Every stage on what the one before kept, against brute force: which rows go, which lines, which copies, which spans, and all ids in windows."""
    import corpus_pipeline

    rng, words = random.Random(23), [f"word{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(sentence(rng.randint(6, 12)) for _ in range(6)), "en", "a") for i in range(120)]
    rows += [(200 + i, "BUY!! NOW!! " * (4 + i % 5), "en", "a") for i in range(60)]
    rows += [(300 + i, f"{rows[i][1].split(chr(10))[0]}\nown {sentence(9)}\nmail me{i}@x.org or call +1 (743) 555-38{i:02}", "en", "b") for i in range(20)]
    for i in range(20):  # near copies that share no whole line
        lines = [line.split(" ") for line in rows[40 + i][1].split("\n")]
        for line in lines:
            line[rng.randrange(len(line))] = f"changed{i}"
        rows.append((400 + i, "\n".join(map(" ".join, lines)), "fr", "b"))
    rows += [(500, None, "en", None), (501, "", None, "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.filter("doc_id % 3 < 2").selectExpr("doc_id", "int(not coalesce(text like 'BUY%', false)) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, Scratch(spark, "test").save(stage(spark, frame, str(tmp_path)), name)
        seen[name] = before.collect(), frame.collect()
        assert name == "packing" or frame.columns == before.columns
    ids = lambda found: {r.doc_id for r in found}
    before, after = seen["quality"]
    assert {r.doc_id for r in before if (r.text or "").startswith("BUY")} & ids(after) == set() and {r[0] for r in rows if r[0] < 200 or 300 <= r[0] < 500} <= ids(after)
    before, after = (sorted(x, key=lambda r: r.doc_id) for x in seen["lines"])
    assert [r.text or "" for r in after] == _new_lines([(r.text or "").split("\n") for r in before]) and any(r.text != s.text for r, s in zip(after, before, strict=True))
    assert all(r.n_chars == len(r.text or "") for r in after)
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: near_dedup.words(r.text or "") for r in before}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and root[i] != root[j] and (near_dedup.edit_similarity(texts[i], texts[j]) >= 0.8 if texts[i] and texts[j] else texts[i] == texts[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert ids(after) == set(root.values()) and len(after) < len(before)
    before, after = seen["personal_data"]
    assert ids(before) == ids(after) and not any(_base(r.text or "") for r in after) and sum("[EMAIL]" in (r.text or "") for r in after) == 20
    before, after = seen["packing"]
    library = Tokenizer.from_file(WORD)
    assert sum(r.length for r in after) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in after)
