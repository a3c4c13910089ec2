"""Snapshot difference, whitening and word-table encoding against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import queries as Q
from sievewright.llm import neardup, packing, pii, quality, snapshot, topk, whitening, wordtable

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, k long, content string"


@pytest.fixture(scope="module")
def word_model():
    return Q.tokenizer_file("word_bpe_49k.json").decode()


def row_sha(row):
    return hashlib.sha256("\n".join("~" if x is None else x for x in row[1:4]).encode()).hexdigest()


def brute_diff(old, new):
    """The contract by loops; repeated keys pair by the order of their contents' digests, as the module says."""
    short = lambda x: "~" if x is None else hashlib.sha256(x.encode()).hexdigest()[:32]
    content = lambda r: hashlib.sha256("".join(map(short, r[1:4])).encode()).hexdigest()[:32]
    out, loose = [], ([], [])
    for key in {r[0] for r in old + new}:
        a, b = (sorted((r for r in rows if r[0] == key), key=content) for rows in (old, new))
        for x, y in zip(a, b):
            changed = ",".join(n for n, i in (("text", 1), ("lang", 2), ("source", 3)) if x[i] != y[i])
            out.append((key, key, "update" if changed else "same", changed, row_sha(y)))
        for side, rows, other in ((0, a, b), (1, b, a)):
            loose[side].extend((r, n) for n, r in enumerate(rows) if n >= len(other))
    place = lambda r: (r[0][0] or 0, r[0][0] is None, r[1])
    for c in {r[1:4] for side in loose for r, _ in side}:
        a = sorted((x for x in loose[0] if x[0][1:4] == c), key=place)
        b = sorted((x for x in loose[1] if x[0][1:4] == c), key=place, reverse=True)
        for (x, _), (y, _) in zip(a, b):
            out.append((y[0], x[0], "rekey", "", row_sha(y)))
        out += [(x[0], x[0], "delete", "", None) for x, _ in a[len(b) :]] + [(y[0], None, "insert", "", row_sha(y)) for y, _ in b[len(a) :]]
    return Counter(out)


def test_snapshot_odd(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "BLOCK", 7)  # contents and keys reach over several blocks
    rng = random.Random(1)
    pool = [None, "", "a", "~", "x" * 30_000, "a\nb", "é"]
    draw = lambda lo, hi: [(rng.choice([None, rng.randrange(lo, hi)]) if rng.random() < 0.1 else rng.randrange(lo, hi), rng.choice(pool), rng.choice([None, "en", "~"]), rng.choice([None, "s"])) for _ in range(250)]
    hot = [(10_000 + i, "copy", "en", "s") for i in range(60)]
    same_key = [(77, "t", "en", "s")] * 40
    old, new = draw(0, 120) + hot + same_key, draw(60, 200) + [(20_000 + i, *x[1:]) for i, x in enumerate(hot[:50])] + same_key[:25]
    frame = lambda rows: spark.createDataFrame([(*r, 1, "clash", 3, "c") for r in rows], DOCS)
    got = Counter((r.key, r.old_key, r.op, r.changed, r.row_sha256) for r in snapshot.diff(frame(old), frame(new)).collect())
    assert got == brute_diff(old, new)
    empty = frame(old).limit(0)
    assert {r.op for r in snapshot.diff(empty, frame(new)).collect()} == {"insert"} and {r.op for r in snapshot.diff(frame(old), empty).collect()} == {"delete"}
    assert snapshot.diff(empty, empty).count() == 0


def test_later_snapshot(spark):
    rows = [(i, None if i % 5 == 0 else f"t{i}", "en", "s", 1, "x", 1, "c") for i in range(200)] + [(None, "n", "en", "s", 1, "x", 1, "c")]
    want = Counter()
    for i, t, lang, source, *_ in rows:
        r = -1 if i is None else zlib.crc32(str(i).encode()) % 10
        if r != 0:
            want[(-1 - i if r in (3, 4) else i, (t or "") + "+" if r == 1 else t, source if r == 2 else lang, lang if r == 2 else None if r == 4 else source)] += 1
        if r == 5:
            want[(-1 - i, t, lang, source)] += 1
    assert Counter(map(tuple, snapshot.later_snapshot(spark.createDataFrame(rows, DOCS)).collect())) == want


def brute_white(vectors, components):
    x = np.stack([np.floor(64 * np.array(v)).astype(int) + 1_000_000 for v in vectors])
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6))
    good = [(rng.normal(size=6) @ mix + 3).tolist() for _ in range(300)]
    good += good[:5]
    ids = [*range(304), None]
    odd = [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf"), *[0.0] * 5]), (905, [1e300] * 6)]
    flat = [(950, [1.0, 2.0]), (951, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7, 7, "x") for r in [*zip(ids, good), *odd, *flat]], "vec_id long, embedding array<double>, n int, id int, v string")
    rows = whitening.whiten(df, 4).collect()
    deviation, white, explained = brute_white(good, 4)
    own = [r for r in rows if r.vec_id not in (950, 951)]
    assert len(own) == 4 * len(good) and {r.n for r in own} == {305} and max(r.identity_error for r in own) < 1e-9
    for c in range(4):
        mine = sorted((r.deviation, r.whitened) for r in own if r.component == c + 1)
        best = min(max(abs(a[1] - b[1]) for a, b in zip(mine, sorted(zip(deviation.tolist(), (sign * white[:, c]).tolist())))) for sign in (1, -1))
        assert best < 1e-8 and all(math.isclose(r.explained, explained[c], rel_tol=1e-9) for r in own if r.component == c + 1)
        assert [a for a, _ in mine] == sorted(deviation.tolist())
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in rows if r.vec_id == 950] == [(2, 0, None, 0.0)] * 2
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_parts():
    """States merge to what one pass has, exact deviations pass 64 bits as nulls, and the solver copes with equal, zero and tiny values."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 5)) * 64) + 1e6
    whole, parts = whitening.State(5), whitening.State(5)
    whole.add(x)
    for a in range(0, 500, 70):
        s = whitening.State(5)
        s.add(x[a : a + 70])
        parts.merge(s)
    centred = x - x.mean(axis=0)
    assert parts.n == 500 and np.allclose(parts.covariance, whole.covariance, rtol=1e-13) and np.allclose(parts.covariance, centred.T @ centred / 500, rtol=1e-12)
    big = np.array([[2.0**40, 0], [0, 2.0**20]])
    assert whitening.deviations(big, 2, [2**40, 2**20]) == [None, None]
    assert whitening.deviations(np.array([[2.0**29, 1]]), 3, [5, 7]) == [(3 * 2**29 - 5) ** 2 + (3 - 7) ** 2]
    for a in (np.eye(4) * 3, np.zeros((3, 3)), np.diag([1.0, 1e-12, 5]), np.ones((6, 6)), (lambda m: m @ m.T)(rng.normal(size=(40, 40)))):
        e, u = whitening.eigen(a)
        assert np.allclose(a @ u, u * e, atol=1e-12 * max(1, np.abs(a).max()) * len(a)) and np.allclose(u.T @ u, np.eye(len(a)), atol=1e-13) and (np.diff(e) <= 0).all()


TEXTS = [
    None, "", "  ", "a", "x" * 30_000, "b a " * 400, "日本語 漢字", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É. J̌ it's 7,8.", "tab\tnew\nline\x0b\x0c\r end ", "́a é  x y",
    "don't we'll DON'T", "\x1c\x1d a\x1fb", "​ ﻿", "Hello, hello. HELLO!", "<|s", "a b a b rare" + "z" * 40,
]


def test_word_table(spark, word_model):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(word_model)
    texts = [*TEXTS, TEXTS[5], *(f"word{i % 50} common text number {i}" for i in range(300))]
    df = spark.createDataFrame([(None if i == 3 else i, t, "en", "s", 1, "x", 2, "clash") for i, t in enumerate(texts)], DOCS).withColumn("at", F.lit(1)).withColumn("chunk", F.lit("c")).repartition(5)
    want = {}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[None if i == 3 else i] = (ids, tok.decode(ids, skip_special_tokens=False))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for most in (wordtable.MOST, 8, 0):  # all common words broadcast, few, none
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordtable.check_round_trip(df, word_model, most=most).collect()}
        assert got == {i: (len(ids), digest(" ".join(map(str, ids))), digest(back)) for i, (ids, back) in want.items()}
    ids = wordtable.encode(df, word_model, most=20)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: x for i, (x, _) in want.items()}
    assert {r.doc_id: r.decoded for r in wordtable.decode(ids, word_model).collect()} == {i: x for i, (_, x) in want.items()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1, 320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in wordtable.decode(odd, word_model).collect()} == {i: tok.decode([x for x in ids if x >= 0], skip_special_tokens=False) for i, ids in ((1, []), (2, []), (3, [10**6, -1, 320]))}
    assert wordtable.check_round_trip(df.limit(0), word_model).count() == 0


def test_word_table_refuses_other_tokenizers(spark):
    with pytest.raises(ValueError):
        wordtable.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), Q.tokenizer_file("byte_bpe_50k.json").decode())


def test_word_table_whole(spark, word_model):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(word_model)
    got = {r.doc_id: r for r in Q.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_topk_large_components(spark):
    """Components of 3e6 and beyond: exact sums, longs' bounds only at the end."""
    rng = random.Random(4)
    rows = [(0, [3e6, 0.0]), (1, [2.5e6, 0.0]), (2, [9e6, 0.0]), (3, [1.0, 1.0]), (4, [0.25, -3.0])]
    wide = [(100 + i, [3e6 + rng.randrange(100) for _ in range(8)]) for i in range(5)] + [(200 + i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(30)] + [(300, [1e305] + [0.0] * 7), (301, [1.7e308] * 8), (302, [-2e12] * 8)]
    df = spark.createDataFrame(rows + wide, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    for group in (rows, [w for w in wide if w[0] != 301]):  # 1024 times the components of 301 isn't finite
        whole = {i: [math.floor(1024 * x) for x in v] for i, v in group}
        for i, q in whole.items():
            best = sorted((-clip(sum(a * b for a, b in zip(q, v))), j) for j, v in whole.items() if j != i)[:6]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert 301 not in got


def test_word_encoder_probes(word_model):
    """With a tokenizer that keeps case, or one whose pieces reach over points, nothing is taken for granted; one that keeps white space is refused."""
    import json

    from tokenizers import Tokenizer

    texts = ["A a. B, the THE Tion. x9, 9. É. don't, A.b", "a." * 50, "Hello WORLD. hello, world"]
    cased = json.loads(word_model)
    cased["normalizer"]["normalizers"] = cased["normalizer"]["normalizers"][:2]
    whole = json.loads(word_model)
    whole["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    for made, lowers, pointed in ((word_model, True, True), (json.dumps(cased), False, True), (json.dumps(whole), True, False)):
        e, t = packing.WordEncoder(made), Tokenizer.from_str(made)
        assert (e.lowers, e.pointed) == (lowers, pointed)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in e.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError):
        packing.WordEncoder(Q.tokenizer_file("byte_bpe_50k.json").decode())


# quality against a plain minimum covariance determinant


def brute_stats(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked), len(lines)


def concentrated(x, at, cov, steps):
    """Concentration steps from a start: the closest three quarters, to whole bins of distance, estimate again."""
    for _ in range(steps):
        d = np.maximum(np.einsum("ij,jk,ik->i", x - at, np.linalg.inv(cov), x - at), 0)
        bins = np.floor(np.log2(d + 1 / 1024) * 16)
        upto = [(b, (bins <= b).sum()) for b in np.unique(bins)]
        cut = next(b for b, n in upto if n >= math.ceil(len(x) * quality.SUPPORT))
        own = x[bins <= cut]
        at, cov = own.mean(axis=0), np.cov(own.T, bias=True) * quality.consistency() + np.eye(4) / quality.GRID**2
    return at, cov


def brute_quality(rows):
    """kept and distance of (doc_id, text, lang, source) by loops over groups."""
    told, vectors = {}, {}
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat, lines = brute_stats(t)
        failed = n < 20 or 100 * repeat > 30 * n
        angle = lambda a, b: math.asin(math.sqrt(min(1, a / max(b, 1))))
        v = [math.log(max(chars, 1) / max(n, 1) / 5), angle(symbols, chars), angle(dup, lines), angle(repeat, n)]
        whole = [math.floor(abs(y) * quality.GRID + 0.5) * (1 if y >= 0 else -1) / quality.GRID for y in v]
        told[i] = (failed, whole, [s / max(m, 1) for s, m in zip(quality.SAMPLING, (n, chars, lines, n))], lang or "", source or "")
        if not failed:
            for g in (("s", lang or "", source or ""), ("l", lang or ""), ("a",)):
                vectors.setdefault(g, []).append(whole)
    out = {}
    for i, (failed, v, own, lang, source) in told.items():
        group = next((g for g in (("s", lang, source), ("l", lang), ("a",)) if len(vectors.get(g, ())) >= quality.MIN_GROUP), None)
        if failed or group is None:
            out[i] = (not failed, None)
            continue
        x = np.array(vectors[group])
        q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
        unit = np.eye(4) / quality.GRID**2
        starts = [(q2, np.diag(((q3 - q1) / 1.349) ** 2) + unit), (x.mean(axis=0), np.cov(x.T, bias=True) + unit)]
        at, cov = min((concentrated(x, a, c, quality.STEPS) for a, c in starts), key=lambda m: np.linalg.slogdet(m[1])[1])
        d = float((np.array(v) - at) @ np.linalg.inv(cov + np.diag(own)) @ (np.array(v) - at))
        out[i] = (d <= quality.chi_square_quantile(1 - quality.TAIL, 4), d)
    return out


def quality_rows(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda n, mark="": "\n".join(" ".join(word() + (mark if rng.random() < 0.5 else "") for _ in range(8)) for _ in range(n))
    rows = []
    for lang, source, n in (("en", "s0", 120), ("en", "s1", 60), ("en", "few", 9), ("de", "rare", 5), (None, None, 50), ("fr", "s0", 25), ("fr", "s1", 25)):
        rows += [(text(rng.randint(4, 30), rng.choice(["", "", "", "#"]) if rng.random() < 0.3 else ""), lang, source) for _ in range(n)]
        rows += [(text(12, "$$$$"), lang, source), ("\n".join([text(1)] * 2 + [text(10)]), lang, source)]
    rows += [(None, "en", "s0"), ("", None, "s1"), ("few words", "en", "s0"), (" ".join(word() for _ in range(8_000)), "en", "s0"), rows[0], rows[0], rows[-1]]
    return [(i, *r) for i, r in enumerate(rows)]


def test_quality_against_brute_force(spark):
    """Groups of their own, the fallbacks to a language and to all rows, ties, nulls, a long text."""
    rows = quality_rows(random.Random(6))
    df = spark.createDataFrame([(i, t, lang, source, 1, "x", 1, "c") for i, t, lang, source in rows], DOCS)
    want = brute_quality(rows)
    got = {r.doc_id: (r.kept, r.distance) for r in quality.judge(df).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)) for (_, a), (_, b) in zip((got[i] for i in want), want.values()))
    assert 5 < sum(not k for k, _ in got.values()) < 60
    few = df.limit(30)
    assert all(r.kept == (not r.base_failed) and r.distance is None for r in quality.judge(few).collect())


def test_quality_near_best_subset(spark):
    """The two starts reach, within a tenth, the smallest determinant that concentration from 300 random subsets finds."""
    rng = np.random.default_rng(7)
    x = np.round(np.r_[rng.normal(size=(90, 4)) * [0.1, 0.05, 0.05, 0.02], rng.normal(size=(20, 4)) * 0.05 + 0.6] * quality.GRID) / quality.GRID
    q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
    unit = np.eye(4) / quality.GRID**2
    two = min(np.linalg.slogdet(concentrated(x, a, c, quality.STEPS)[1])[1] for a, c in ((q2, np.diag(((q3 - q1) / 1.349) ** 2) + unit), (x.mean(axis=0), np.cov(x.T, bias=True) + unit)))
    best = np.inf
    for _ in range(300):
        own = x[rng.choice(len(x), 6, replace=False)]
        best = min(best, np.linalg.slogdet(concentrated(x, own.mean(axis=0), np.cov(own.T, bias=True) + unit, 10)[1])[1])
    assert two <= best + math.log(1.1) * 4


def brute_components(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_pipeline_against_brute_force(spark, word_model, tmp_path):
    """All four stages on a small table with nulls, copies and personal data: quality by loops, near-duplicates by all pairs, spans put in place by loops, ids by the library."""
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    rows = quality_rows(random.Random(8))
    good = [t for _, t, _, _ in rows if t and len(t.split()) > 40]
    turned = lambda t: " ".join(t.split()[::-1])
    more = [good[0] + " extra", good[1].replace("a", "A"), turned(good[2]) + " mail jo@site.org now", turned(good[3]) + " call +49 30 1234567 or 4111 1111 1111 1111", good[4]]
    rows += [(len(rows) + n, t, "en", "s0") for n, t in enumerate(more)]
    docs = spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "c") for i, t, lang, source in rows], DOCS)
    at = f"{tmp_path}/documents.parquet"
    docs.write.parquet(at)
    stage = dict(C.STAGES)
    one = stage["quality rules"](spark, spark.read.parquet(at), str(tmp_path))
    assert one.columns == docs.columns
    kept = {i: t for (i, t, *_), (k, _) in zip(rows, brute_quality(rows).values()) if k}
    assert {r.doc_id: r.text for r in one.collect()} == kept
    roots = brute_components(list(kept.items()))
    two = stage["near-duplicates"](spark, one, str(tmp_path))
    firsts = {i: t for i, t in kept.items() if roots[i] == i}
    assert {r.doc_id: r.text for r in two.collect()} == firsts and len(firsts) < len(kept)
    spans = {r.doc_id: r.spans for r in pii.find(two).collect()}
    want = {}
    for i, t in firsts.items():
        out, end = [], 0
        for x in sorted(spans[i], key=lambda x: (x.start, x.end)):
            if x.start >= end:
                out += [t[end : x.start], f"[{pii.KINDS[x.kind].upper()}]"]
            end = max(end, x.end)
        want[i] = "".join(out) + t[end:]
    three = stage["personal data"](spark, two, str(tmp_path))
    assert {r.doc_id: r.text for r in three.collect()} == want and any("[EMAIL]" in t for t in want.values()) and any("[CARD]" in t for t in want.values())
    tok, packed = Tokenizer.from_str(word_model), C.run(spark, str(tmp_path)).toPandas()
    for i, t in want.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        g = packed[packed.doc_id == i].sort_values("start")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist() and g.length.sum() == len(ids)
    assert set(packed.doc_id) == set(want) and packed.groupby("sequence_id").length.sum().max() <= 4096
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert C.run(spark, empty).count() == 0
