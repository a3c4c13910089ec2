import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import chat, counts, hmm, neardup, packing, pii, quality, topk, urls, viterbi
from sievewright.llm import queries as Q
from tests.conftest import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
ODD = [None, "", "  ", "a", "x" * 3000, "a b c d", "b a " * 40, "a\u2581 \u2581b", "日本語 漢字", "<s> </s> <|endoftext|> Ab.", "É. J\u030c it's 7,8."]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i % 2 else "en", None, 1, "clash") for i, t in enumerate([*ODD, ODD[6]])], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def piece_model():
    return Q.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def word_model():
    return Q.tokenizer_file("word_bpe_49k.json").decode()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    mine, theirs = same(spark, SF, Q.QUERIES[name], Q.ORACLE[name])
    assert mine == theirs


# quality


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics(spark, odd):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = {r.doc_id: r for r in quality.judge(df).collect()}
        for i, t in texts:
            n, c, s, d, w = brute_statistics(t)
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, s, d, w)
            assert r.base_failed == (n < 20 or 100 * w > 30 * n) and not (r.base_failed and r.kept)


def test_quality_outlier(spark, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(120)), "en", "s", 0, "x") for i in range(80)]
    rows.append((99, " ".join(word() + "$$$###" for _ in range(120)), "en", "s", 0, "x"))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got.pop(99) and all(got.values())
    assert quality.judge(empty).count() == 0
    assert quality.filter_documents(spark.createDataFrame(rows, DOCS)).columns == [x.split()[0] for x in DOCS.split(", ")]


def test_quality_short_outlier(spark):
    """A tenth of the characters of a short text, or half of its 20 lines, is far beyond chance; one symbol or one repeated line isn't."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(5)) for _ in range(20)), "en", "s", 0, "x") for i in range(80)]
    lines = rows[0][1].split("\n")
    odd = [" ".join(w + "#" * (n % 2) for n, w in enumerate(rows[1][1].split())), "\n".join(x for x in [*lines[:10], *(["ab cd"] * 10)]), rows[2][1] + "#", "\n".join([*lines[:18], "ab cd", "ab cd"])]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows + [(100 + i, x, "en", "s", 0, "x") for i, x in enumerate(odd)], DOCS)).collect()}
    assert not any(got[100 + i].base_failed for i in range(4))
    assert [got[100 + i].kept for i in range(4)] == [False, False, True, True] and all(got[i].kept for i in range(80))


def test_inverse(spark):
    a = np.array([[4.0, 1, 0.5, 0.2], [1, 3, 0.3, 0.1], [0.5, 0.3, 2, 0.4], [0.2, 0.1, 0.4, 1]])
    r = spark.range(1).select(quality._inverted(F.array(*(F.lit(float(x)) for x in a.ravel()))).alias("i")).first().i
    assert np.allclose(np.array(r.a).reshape(4, 4), np.linalg.inv(a)) and math.isclose(r.ld, math.log(np.linalg.det(a)))


# tokens


def test_viterbi(spark, odd, empty, piece_model):
    c = viterbi.Codec(piece_model)

    def best(s):
        at = [(0.0, [])]
        for end in range(1, len(s) + 1):
            found = None
            for a in range(end):
                v = c.pieces.score.get(s[a:end])
                if v is None and a == end - 1:
                    v = c.search.unknown
                if v is not None and (found is None or at[a][0] + v > found[0]):
                    found = (at[a][0] + v, [*at[a][1], s[a:end]])
            at.append(found)
        return [i for p in at[-1][1] for i in ([c.pieces.id[p]] if p in c.pieces.id else [c.pieces.byte_id[b] for b in p.encode()])]

    for t in [*ODD[1:], "the quick brown fox  jumps"]:
        want = best(("\u2581" + t.replace(" ", "\u2581"))[:400]) if t else []
        t = t[:399]
        assert np.frombuffer(c.encode(t), dtype="<u4").tolist() == want
        if t:
            assert viterbi.StreamingViterbi(c.pieces).encode("\u2581" + t.replace(" ", "\u2581")) == want
    # every stretch goes through the window: fed in parts it gives the same ids, and long texts without spaces are never held whole
    rng = random.Random(9)
    for t in ["".join(rng.choice("abcdeéß漢 ") for _ in range(3_000)).replace(" ", ""), "x" * 5_000, "ab" * 2_500, "<0x0A>" * 500]:
        want, stream, got, at = best(t), viterbi.StreamingViterbi(c.pieces), [], 0
        while at < len(t):
            step = rng.randint(1, 40)
            got += stream.push(t[at : at + step])
            at += step
        assert got + stream.finish() == want and stream.widest <= 12 * c.pieces.longest
    got = viterbi.check_round_trip(odd, piece_model).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    back = {r.doc_id: r.text for r in viterbi.decode(viterbi.encode(odd, piece_model), piece_model).collect()}
    assert back[8] == ODD[8] and back[0] == ""
    assert viterbi.check_round_trip(empty, piece_model).count() == 0


def test_counts(spark, odd, empty, piece_model):
    c = counts.PrefixCounts(piece_model)
    sp = c.pieces.library
    for t in [*ODD[1:], "   x  y", "\n\n a\n", "      indented   code \t"]:
        t = t[:300]
        a = c.all_prefixes(t)
        assert a == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        for limit in (1, 3, 20):
            assert c.cut(t, limit) == max(i for i, n in enumerate(a) if n <= limit)
    docs = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in counts.count_tokens(odd, piece_model, 5).collect():
        t = docs[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 5)
    assert counts.count_tokens(empty, piece_model).count() == 0


def test_packing(spark, odd, empty, word_model):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(word_model)
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        docs = {r.doc_id: r.text or "" for r in df.collect()}
        p = packing.pack(df, word_model).toPandas()
        for i, t in docs.items():
            ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
            g = p[p.doc_id == i].sort_values("start")
            assert g.length.sum() == len(ids) and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
        p = p.sort_values(["sequence_id", "offset"])
        assert ((p.groupby("sequence_id").length.cumsum() - p.length) == p.offset).all() and p.groupby("sequence_id").length.sum().max() <= 4096
    assert packing.pack(empty, word_model).count() == 0


def test_fill():
    rng = random.Random(2)
    for _ in range(200):
        have = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        used = packing.fill(have, room)
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        assert sum(x * n for x, n in used.items()) == max(sums) and all(n <= have[x] for x, n in used.items())


# language model


def test_chain():
    rng = np.random.default_rng(0)
    k, c = hmm.K, 7
    start, move, emit = rng.random(k), rng.random((k, k)), rng.random((c, k))
    chain = hmm.Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    seqs = [rng.integers(0, c, n) for n in (1, 63, 64, 65, 200)]
    logs, xi, em = [], np.zeros((k, k)), np.zeros((c, k))
    for s in seqs:
        a, b, z = np.zeros((len(s), k)), np.ones((len(s), k)), []
        for t, x in enumerate(s):
            a[t] = (chain.start if not t else a[t - 1] @ chain.move) * chain.emit[x]
            z.append(a[t].sum())
            a[t] /= z[-1]
        for t in range(len(s) - 2, -1, -1):
            b[t] = chain.move @ (chain.emit[s[t + 1]] * b[t + 1]) / z[t + 1]
            xi += chain.move * np.outer(a[t], chain.emit[s[t + 1]] * b[t + 1]) / z[t + 1]
        np.add.at(em, s, a * b)
        logs.append(np.log(z).sum())
    _, m, e, total = hmm.expectations(chain, seqs)
    assert np.allclose(m, xi) and np.allclose(e, em) and math.isclose(total, sum(logs)) and np.allclose(hmm.log_likelihoods(chain, seqs), logs)


def test_hmm(spark, odd, empty):
    rows = hmm.score(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    docs = {r.doc_id: r.text for r in odd.collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for i, t in docs.items()}
    seen = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for r in hmm.score(odd).collect():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-6) and math.isfinite(r.score)
    assert hmm.score(empty).count() == 0


def test_hmm_every_word_has_emissions(spark):
    """All three kinds of words (own, sent along, joined) against one dense table over the vocabulary; held-out texts have unknown words too."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}ing" if n % 3 else f"{a}{b}ed" for n, (a, b) in enumerate((a, b) for a in "abcdef" for b in "uvwxyz")]
    docs = []
    for i in range(60):
        half = vocabulary[:18] if i % 2 else vocabulary[18:]
        docs.append((i, " ".join(half[min(int(rng.exponential(6)), 17)] for _ in range(40)) + (" unseen" if i % 7 == 2 else ""), "en" if i % 2 else "de", None, 1, None))
    own, k = 3, hmm.K
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(docs, DOCS), own=own, frequent=9).collect()}
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    texts = {i: hmm.tokens(t.encode()) for i, t, *_ in docs}
    seen = Counter(w for i, ws in texts.items() if i not in held for w in ws)
    ranked = sorted((c for w, c in seen.items() if w != hmm.END), reverse=True)
    least = next((c for c in sorted(set(seen.values())) if sum(x >= c for x in seen.values()) <= own - 1), 2**62)
    words = sorted({w for ws in texts.values() for w in ws})
    big = [hmm.END, *(w for w in words if seen[w] >= least and w != hmm.END)]
    group = {w: big.index(w) if w in big else own + hmm.shared_class(w) for w in words}
    assert len(ranked) > 20 and len(big) < 5
    at = {w: n for n, w in enumerate(words)}
    groups = np.array([group[w] for w in words])
    kinds = np.bincount([group[w] for w in seen if w not in big], minlength=own + hmm.SHARED)
    training = [i for i in texts if i not in held]
    sequences = {i: np.array([at[w] for w in ws]) for i, ws in texts.items()}
    tied = [groups[sequences[i]] for i in training]

    # steps over classes, then one that tells the words of a class apart
    sums = np.zeros((own + hmm.SHARED, k))
    langs = [x for x, _ in sorted(Counter(docs[i][2] for i in training).items(), key=lambda x: (-x[1], x[0]))]
    for i, s in zip(training, tied):
        np.add.at(sums[:, langs.index(docs[i][2])], s, 1.0)
    total = sums.sum(axis=0)
    spread = (sums.sum(axis=1) + 0.5) / (sums.sum() + 0.5 * len(sums))
    made, before = hmm.reestimated(total, np.eye(k) * total[:, None] * 0.05, sums, spread), -np.inf
    while True:
        start, move, sums, log = hmm.expectations(made, tied)
        if log - before < hmm.TOLERANCE * sum(seen.values()):
            break
        made, before = hmm.reestimated(start, move, sums, spread), log
    start, move, emit, _ = hmm.expectations(made, tied, [sequences[i] for i in training], len(words))
    sums = np.zeros((own + hmm.SHARED, k))
    np.add.at(sums, groups, emit)
    made = hmm.reestimated(start, move, sums, spread)
    inside = np.where((groups < own)[:, None], 1.0, (emit + 1) / (sums[groups] + kinds[groups][:, None] + 1))
    made = hmm.Chain(made.start, made.move, made.emit[groups] * inside)
    for i, s in sequences.items():
        assert math.isclose(got[i], float(hmm.log_likelihoods(made, [s])[0]) / math.log(10), abs_tol=1e-5)


# near-duplicates


def test_neardup_edges(spark, odd, empty):
    got = {r.doc_id: r for r in neardup.components(odd).collect()}
    assert got[0].n_shingles == 0 and got[0].kept and got[3].n_shingles == 1 and got[11].component_id == 6 and not got[11].kept
    assert neardup.components(empty).count() == 0 and neardup.deduplicate(empty).count() == 0
    left = neardup.deduplicate(odd.unionByName(odd))
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == list(range(11))


def _across(spark, sets, roots):
    members = spark.createDataFrame(list(enumerate(roots)), "id long, root long")
    return sorted((r.a, r.b) for r in neardup.across(members, spark.createDataFrame(list(enumerate(map(sorted, sets))), "id long, s array<long>")).collect())


def test_neardup_across_misses_no_link(spark):
    rng = random.Random(5)
    sets, roots = [], []
    for family in range(6):
        core = rng.sample(range(family * 50, family * 50 + 400), 120)
        for k in range(12):
            own = set(rng.sample(core, rng.randint(85, 120))) | {rng.randrange(10_000) for _ in range(rng.randint(0, 20))}
            sets.append(own)
            roots.append(rng.randrange(3) * 100 + family if k % 2 else 1_000 + len(sets))
    sets += [{1}, {1}, {1, 2, 3, 4}, {1, 2, 3}, set(sets[0])]  # shortest sets, and equal ones under two roots
    roots += [1, 2, 3, 4, 5_000]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if roots[a] != roots[b]]
    true = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = _across(spark, sets, roots)
    assert len(true) > 50 and set(true) <= set(found) <= set(pairs)
    assert _across(spark, sets, [0] * len(sets)) == []


def test_neardup_across_pairs_no_family_below_the_threshold(spark):
    # 846 of 996 shingles in common, a similarity of 0.738: 19,900 pairs, none of which is made
    sets = [set(range(846)) | {1_000 * k + j for j in range(850, 1_000)} for k in range(1, 201)]
    assert _across(spark, sets, list(range(200))) == []
    sets[7] = set(sets[3]) | {-1}
    assert _across(spark, sets, list(range(200))) == [(3, 7)]


def test_neardup_parities_lose_no_link(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 15, 16, 17, 1_000, 30_000)]
    for u in sets[:]:  # kin of all similarities, from equal sets to a half in common
        for share in (1.0, 0.95, 0.9, 0.857, 0.8, 0.7, 0.5):
            kept = u[: max(1, int(len(u) * share))]
            sets.append(kept)
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, len(u) - len(kept), dtype=np.uint64)])))
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 3 * max(len(sets[a]), len(sets[b])) <= 4 * min(len(sets[a]), len(sets[b]))]
    true = {(a, b) for a, b in pairs if linked(sets[a], sets[b])}
    held = spark.createDataFrame([(k, u.view(np.int64).tolist(), neardup.parity(u).view(np.int64).tolist()) for k, u in enumerate(sets)], "id long, s array<long>, bits array<long>")
    close = {(r.a, r.b) for r in neardup.near_enough(spark.createDataFrame(pairs, "a long, b long"), held).collect()}
    assert len(true) > 80 and true <= close and len(close - true) < len(set(pairs) - true) // 4


def test_neardup_family_of_shared_paragraphs(spark, monkeypatch):
    """Below the threshold in pairs, mostly, but with a paragraph in common: few sets meet, and all links are found."""
    rng = random.Random(5)
    core, paragraphs = list(range(700)), [[1_000 + 40 * p + j for j in range(40)] for p in range(60)]
    texts = [" ".join(f"w{w}" for w in core + [w for p in rng.sample(paragraphs, 7) for w in p]) for _ in range(120)]
    met = []
    true_near = neardup.near_enough

    def near(pairs, sets):
        found = true_near(pairs, sets)
        met.append((pairs.count(), found.count()))
        return found

    monkeypatch.setattr(neardup, "near_enough", near)
    got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert all(close <= made // 20 + 5 for made, close in met)


def test_neardup_chain_beyond_the_star(spark):
    """A chain of edits: ends unlike each other, all one component."""
    rng = random.Random(3)
    base, rows = [f"w{rng.randint(0, 10**6)}" for _ in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(base), "en", "s", 0, "x"))
        base = [*base]
        for _ in range(4):
            base[rng.randrange(300)] = f"n{rng.randint(0, 10**6)}"
    got = neardup.components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0}


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii(spark, empty):
    texts = [
        None, "", "a@b.c_x@d.e a@@b@c.d.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4", "4111 1111 1111 1111 5500-0000-0000-0004 41111111111111111111", "+1 (555) 123-4567 +12 ++49 30 1234567-",
        "é@ñ.com é a.b%c+d@x-y.co.uk", "9" * 5000, "1." * 3000, "a" * 5000 + "@", "1 " * 3000, "a@b.c " * 300, "plain words only",
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)
    for r in pii.find(df).collect():
        assert [(pii.KINDS[x.kind], x.start, x.end) for x in r.spans if x.base] == brute_spans(texts[r.doc_id] or "")
    made = {r.doc_id: r for r in pii.mask(df).collect()}
    assert made[6].text == "é@ñ.com é [EMAIL]" and made[6].n_chars == 17 and made[12].text == texts[12] and made[0].text is None
    assert pii.find(empty).count() == 0


def test_pii_estimate_and_classifier():
    """Votes drawn from labelers of known reliability: expectation-maximisation finds the truth and the rates behind it, and the classifier gives the same verdicts."""
    rng = random.Random(5)
    right, drawn = [0.97, 0.9, 0.85, 0.95, 0.6], Counter()
    truth: dict = {}
    for _ in range(20_000):
        t = rng.random() < 0.3
        votes = tuple(-1 if j == 2 and rng.random() < 0.5 else int(t == (rng.random() < right[j])) for j in range(5))
        drawn[votes] += 1
        truth.setdefault(votes, []).append(t)
    patterns = [(0, v, 0, n) for v, n in sorted(drawn.items())]
    p = pii.estimate(patterns)
    wrong = sum(n * abs(q - sum(truth[v]) / n) for q, (_, v, _, n) in zip(p, patterns)) / 20_000
    assert wrong < 0.02
    w = pii.train(patterns, p)
    score = lambda v: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, pii.features(0, v, 0)))))
    assert sum(n for q, (_, v, _, n) in zip(p, patterns) if (q > 0.5) != (score(v) > 0.5)) < 200
    assert pii.estimate([]) == [] and pii.train([], []) == [0.0] * (len(pii.KINDS) + 2 * pii.LABELERS + 1)


def brute_chosen(all_, w):
    """chosen() by loops."""
    base = [x for x in all_ if x["base"]]
    meets = lambda x, y: x["start"] < y["end"] and y["start"] < x["end"]
    score = lambda x: sum(a * b for a, b in zip(w, pii.features(x["kind"], tuple(x["votes"]), x["long"])))
    free = [x for x in all_ if not x["base"] and score(x) >= math.log(pii.SURE / (1 - pii.SURE)) and not any(meets(x, b) for b in base)]
    taken = []
    for x in sorted(free, key=lambda x: (x["start"], x["kind"], x["end"])):
        if not any(meets(x, y) for y in taken):
            taken.append(x)
    return sorted((x["kind"], x["start"], x["end"], x["base"]) for x in base + taken)


def test_pii_added_spans(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    texts = [
        f'api token = "{key}" in use', f'the token="{key[::-1]}".', f"commit {key} of the tree", "a" * 50, f"token: {'9' * 30}", "call 555-123-4567 or (555) 123-4567 now", "phone 555.123-4567, +1 555 123 4567",
        "mail jo [at] site [dot] org or jo@site.org", "card 4111 1111 1111 1 or 378282246310005", "2001:0db8:85a3:0000:0000:8a2e:0370:7334 host", None, "",
    ]
    more = [f'my token = "{key[i % 40 :]}{key[: i % 40]}" ok' for i in range(100)] + [f"mail a{i}@site.org" for i in range(100)]
    rows = [(i, t, "en", "s", 0, "x") for i, t in enumerate(texts * 6 + more)]
    df = spark.createDataFrame(rows, DOCS)
    cands = df.select("doc_id", pii.candidates(F.col("text")).alias("c"))
    w = pii.fit(cands)
    raw = {r.doc_id: [x.asDict() for x in r.c] for r in cands.collect()}
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find(df).collect()}
    assert got == {i: brute_chosen(c, w) for i, c in raw.items()}
    secret = pii.KINDS.index("secret")
    start = texts[0].index(key)
    assert (secret, start, start + 40, False) in got[0] and any(x[0] == secret for x in got[1]) and not got[2] and not got[3]
    assert sum(not x[3] for s in got.values() for x in s) > 12
    # base spans alone, were the classifier to say no to all
    none = df.select(pii.chosen(pii.candidates(F.col("text")), [-9.0] * len(w)).alias("s"))
    assert none.filter(F.exists("s", lambda x: ~x["base"])).count() == 0
    # ties and overlaps
    x = lambda k, a, b: {"kind": k, "start": a, "end": b, "base": False, "votes": [1] * 5, "long": 0}
    all_ = [x(0, 0, 9), x(1, 0, 9), x(0, 5, 12), x(2, 20, 25), x(2, 20, 25), x(3, 25, 30)]
    made = spark.createDataFrame([(all_,)], "c array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,long:int>>")
    told = made.select(pii.chosen(F.col("c"), [9.0] * len(w)).alias("s")).first().s
    assert [tuple(y) for y in told] == brute_chosen(all_, [9.0] * len(w))
    # a chain: the first and the third overlap the second alone
    chain = spark.createDataFrame([([x(0, 0, 10), x(1, 8, 18), x(2, 16, 24)],)], made.schema)
    assert [(y.kind, y.start) for y in chain.select(pii.chosen(F.col("c"), [9.0] * len(w)).alias("s")).first().s] == [(0, 0), (2, 16)]
    clean = pii.mask(df).filter("doc_id = 0").first()
    assert clean.text == 'api token = "[SECRET]" in use'


# search, urls, chat


def test_topk(spark):
    rows = [(i, [((i * 37 + j * 11) % 17 - 8) / 9 for j in range(8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [1.0]), (None, [1.0] * 8), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:300]}
    got = topk.search(df, df.filter("vec_id % 100 = 0 OR vec_id = 303"), 5).collect()
    for i in (0, 100, 200):
        want = sorted(((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [(j, -s) for s, j in want]
    assert {r.query_id for r in got} == {0, 100, 200}
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    clash = df.withColumn("v", F.lit("x")).withColumn("id", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    again = topk.search(clash, clash.filter("vec_id % 100 = 0"), 5).filter("query_id IN (0, 100, 200)").collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r) for r in got)


def test_topk_threshold():
    """The threshold leaves few pairs to resolve, never loses one that reaches the cutoff, and with the threshold off all are left."""
    rng = np.random.default_rng(4)
    q, c = (np.floor(1024 * rng.normal(size=(n, 32)) / 6) for n in (20, 3000))
    full = q @ c.T
    cut = np.sort(full, axis=1)[:, -10].astype(np.int64)
    left = topk.candidates(topk.partial_scores(q, c), cut)
    assert left[full >= cut[:, None]].all() and left.mean() < 0.5
    assert topk.candidates(topk.partial_scores(q, c), np.full(20, -(2**62))).all()
    rows, cols = np.nonzero(left)
    assert (topk.resolved(q, c, rows, cols) == full[rows, cols]).all()
    big = q * 2.0**40
    assert [int(x) for x in topk.partial_scores(big, c)[0][0, :3]] == [sum(int(a) * int(b) for a, b in zip(big[0, :8], v[:8])) for v in c[:3]]


def test_cascade(spark):
    universe = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    listed = universe.filter("cast(k as int) % 7 = 0")
    cascade = urls.build_cascade(universe, listed)
    wrong = universe.filter(cascade.contains(F.col("k")) != (F.col("k").cast("int") % 7 == 0))
    assert len(cascade.levels) > 1 and wrong.count() == 0
    assert urls.build_cascade(universe, listed.filter("false")).levels == []


def test_cascade_shards(spark):
    """With a low bound the same answers come from several shards; null keys, repeated rows and clashing columns stay."""
    rows = spark.range(30_000).select(F.when(F.col("id") != 5, F.col("id").cast("string")).alias("u"), F.lit(1).alias("k"), F.lit(2).alias("l"))
    rows = rows.unionByName(rows.limit(10))
    listed = rows.filter("cast(u as int) % 7 = 0").select(F.col("u").alias("k"))
    for most in (urls.MAX_BYTES, 4_096):
        got = urls.list_membership(rows, F.col("u"), listed, most)
        assert got.columns == ["u", "k", "l", "__listed"] and got.count() == 30_010
        assert got.filter("__listed <> coalesce(cast(u as int) % 7 = 0, false)").count() == 0
    assert urls.list_membership(rows.limit(0), F.col("u"), listed).count() == 0
    # a filter kept small takes in more, and never leaves a key out
    bits, held = urls.prefilter(listed, 4_000, 4_096)
    assert bits == 32_768 and listed.filter(~urls.contains(F.col("k"), 0, bits, held)).count() == 0


def test_deduplicate_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text of {i % 700} " * 5, "en", "s", 0, "x") for i in range(1_400)], DOCS)
    monkeypatch.setattr(neardup, "list_membership", lambda *a, **k: urls.list_membership(*a, most=4_096, **k))
    assert sorted(r.doc_id for r in neardup.deduplicate(docs).collect()) == list(range(700))


def test_urls_odd(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y"), (4, "x://net"), (5, "x://b.org/fr/"), (6, "x://b.org/fr/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame([("b.org/fr/",)], "k string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("net", "", None, "allow") and got[5] == ("b.org", "/fr/", "org/fr/", "allow")


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", None, "\\s\\l", ""]
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us: er", t, "x") for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, piece string")
    r = chat.format_chat(df).select("*", chat.parse(F.col("formatted")).alias("p")).first()
    assert [(x.role, x.text) for x in r.p] == [("assistant" if i % 2 else "us: er", t or "") for i, t in enumerate(texts)]
    assert [chat.OPEN not in r.formatted[s.start : s.end] and r.formatted[s.end :].startswith(chat.CLOSE) for s in r.loss_spans] == [True, True]
    assert chat.format_chat(df.limit(0)).count() == 0
    records = [
        (1, '{"prompt":"a","response":"b"}'), (2, '{"instruction":"i","input":"n","output":"o"}'), (3, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"r"}]}'),
        (4, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}'), (5, '{"other":1}'), (6, None),
    ]
    got = {}
    for x in chat.canonical_json(spark.createDataFrame(records, "conv_id long, j string"), "j").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "i\nn"), ("assistant", "o")], 3: [("user", "q"), ("assistant", "r")], 4: [("user", "q"), ("assistant", "r")], 5: [(None, None)], 6: [(None, None)]}


def test_chat_mixed_layouts(spark):
    """Rows of one table go by their own fingerprints; extra fields don't count, elements after the first do, and what has no mapping is kept as it is."""
    schema = "conv_id long, turn long, role string, text string, prompt string, response string, messages array<struct<role: string, content: string, name: string>>, extra int"
    rows = [
        (1, 0, "user", "a", None, None, None, 1), (1, 1, "assistant", None, None, None, None, None), (2, None, None, None, "p", "r", None, 5), (3, None, None, None, "p", None, None, 5),
        (4, None, None, None, None, None, [(None, None, "n"), ("user", "q", None), ("assistant", "s", None)], 5), (5, 0, "user", "a", "p", "r", None, 5), (None, 3, None, None, None, None, None, 1),
        (1, 1, "assistant", None, None, None, None, None),
    ]
    got = {}
    for x in chat.canonical(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
        assert (x.unmapped is not None) == (x.conv_id == 5)
    assert got[1] == [("user", "a"), ("assistant", ""), ("assistant", "")] and got[2] == [("user", "p"), ("assistant", "r")] and got[3] == [("user", "p"), ("assistant", "")]
    assert got[4] == [("", ""), ("user", "q"), ("assistant", "s")] and got[5] == [(None, None)] and got[None] == [("", "")]
    # without the fingerprints every row would be a turn
    assert chat.format_chat(spark.createDataFrame(rows, schema)).filter("conv_id = 2").select(chat.parse(F.col("formatted")).alias("p")).first().p[1].text == "r"
    made = chat.canonical_json(spark.createDataFrame([(1, '{"id":1,"prompt":"a","response":"b"}'), (2, '{"prompt":"a","messages":[{"role":"user","content":"q","name":"n"}]}'), (3, '{"id":2,"messages":[{"name":"x","role":"user"},{"content":"q"}]}')], "conv_id long, j string"), "j")
    found = {r.conv_id: r for r in made.orderBy("turn").collect()}
    assert found[1].text == "b" and found[2].unmapped.startswith('{"prompt"') and found[3].text == "q"
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1).withColumnRenamed("id", "conv_id"))


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in C.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
    assert C.run(spark, SF).select("doc_id").distinct().count() == docs.count()
