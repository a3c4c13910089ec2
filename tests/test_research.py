"""Operators without SQL against loops in Python."""

import difflib
import re

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import changes, chunking, context, pages, planner, retrieval, sources
from sievewright.sources import connectors
from sievewright.streaming import feeds

clean = lambda x: " ".join((x or "").split())


def lines_of(text):
    """The sequential rule of clean_lines()."""
    out, seen = [], {}
    text = re.sub(r"(?i)https?://\S+\.(?:png|jpg|jpeg|gif|svg|webp)\S*", "", (text or "").replace("\r\n", "\n").replace("\r", "\n"))
    for line in map(clean, text.split("\n")):
        key, n = re.sub(r"\W+", " ", line.lower()).strip(), len(line.split())
        noisy = bool(re.search(rf"(?i)\b({T.NOISE})\b", line)) and n <= 18 or key.startswith(T.NAVIGATION)
        if line and key and (noisy or (len(key) <= 4 and seen.get(key, 0) >= 1) or (seen.get(key, 0) >= 2 and n <= 24)):
            continue
        if line:
            seen[key] = seen.get(key, 0) + 1
        out.append(line)
    return out


TEXTS = [
    None, "", "one line", "Home page\nok\nok\nok\nok it is\nok it is\nok it is\n!!\n!!\n!!\n" + "long line " * 15 + "\n" + "long line " * 15 + "\n" + "long line " * 15, "a\n\n\n\nb\r\nc http://x/y.PNG?1 d\n\n",
    "# Intro\n" + "\n\n".join(f"block {i} " + "word " * 60 for i in range(80)) + "\n\n# Method\nf(x) = y + 1234 here\n\n" + " ".join(f"w{i}" for i in range(4000)),
    "\n".join(f"line {i} accuracy" if i % 9 == 0 else f"line {i}" for i in range(40)),
]


def brute_split(text, size, overlap):
    content = re.sub(r"\n{3,}", "\n\n", "\n".join(lines_of(text))).strip()
    windows = lambda w, m, o: [" ".join(w[i : i + m]) for i in range(0, 1 if len(w) <= m else m - m + len(w) - m + (m - o), m - o)] if w else []

    def blocks(x):
        return [clean(b) for b in re.split(r"\n\s*\n+", x) if clean(b)]

    def pack(parts, m, o):
        out, now, n = [], [], 0
        for p in parts:
            k = len(clean(p).split())
            if k and (k > m or (now and n + k > m)):
                out += ["\n\n".join(now)] if now else []
                now, n = [], 0
            if k > m:
                out += windows(clean(p).split(), m, o)
            elif k:
                now.append(clean(p))
                n += k
        return out + (["\n\n".join(now)] if now else [])

    def linked(chunks, o):
        return [c if not i or not o else " ".join(chunks[i - 1].split()[-o:]) + "\n\n" + clean(c) for i, c in enumerate(chunks)]

    heading = lambda x: bool(x) and len(x) <= 140 and (x.startswith("#") or bool(re.search(T.HEADING, x)) or bool(re.match(r"^\d+(?:\.\d+)*[.)]\s+[A-Z][A-Za-z0-9 ,:;()/_-]{3,}$", x)))
    parts, fenced = [], False
    for line in content.split("\n"):
        fenced ^= line.strip().startswith("```")
        if parts and not fenced and heading(line.strip()):
            parts.append([])
        parts = parts or [[]]
        parts[-1].append(line.rstrip())
    whole = [x for p in parts if clean(x := "\n".join(p).strip())]
    whole = [y for x in whole for y in ([x] if len(x.split()) <= 3000 else blocks(x))]
    parents = linked(pack(whole, 3000, 240), 240) or ([clean(content)] if clean(content) else [])
    made = [("regular", c) for c in dict.fromkeys(linked(pack(blocks(content), size, overlap), overlap))]
    rows = [x for x in content.split("\n") if clean(x)]
    near = [" ".join(clean(" ".join(rows[max(0, i - 3) : i + 4])).split()[: max(120, size // 2)]) for i, x in enumerate(rows) if re.search(T.SIGNAL, x)]
    made += [("signal", c) for c in dict.fromkeys(near)]
    out = []
    for kind, c in made:
        own = set(c.lower().split())
        best = max(range(len(parents)), key=lambda k: (len(own & set(parents[k].lower().split())), -k), default=0)
        out.append((kind, c, best, len((parents[best] if parents else c).split())))
    return out


def test_split_document(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept = {r.doc_id: r.t for r in df.select("doc_id", sources.clean_text(F.col("text")).alias("t")).collect()}
    assert all(kept[i] == re.sub(r"\n{3,}", "\n\n", "\n".join(lines_of(t))).strip() for i, t in enumerate(TEXTS))
    for size, overlap in ((1200, 180), (120, 20)):
        got = {}
        for r in chunking.split_document(df, ["doc_id"], F.col("text"), size, overlap).orderBy("doc_id", "place").collect():
            got.setdefault(r.doc_id, []).append((r.kind, r.chunk, r.parent_index, r.parent_token_count))
        for i, t in enumerate(TEXTS):
            assert got.get(i, []) == brute_split(t, size, overlap), i
    assert chunking.split_document(df.limit(0), ["doc_id"], F.col("text")).count() == 0


def test_packed_and_sections(spark):
    row = spark.createDataFrame([("# A\nx\n```\n# no\n```\n# B\ny",)], "t string").select(chunking.sections(F.col("t")).alias("s"), chunking.overlapped(F.lit(["a b c", "d e"]), 2).alias("o"))
    r = row.first()
    assert r.s == ["# A\nx\n```\n# no\n```", "# B\ny"] and r.o == ["a b c", "b c\n\nd e"]


def test_stored_headers(spark):
    long = "evidence words that go on and on " * 6
    rows = [(f"Source: T\nURL: u\nTask: c\n\n{long}", "T", "u", "c"), (clean(f"Source: T URL: u Task: c {long}"), "T", "u", "c"), ("Source: T URL: u Task: c", "T", "u", "c"), (clean(f"x Task: c {long}"), "", "", "c"), ("short", "", "", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, t string, u string, c string")
    got = [r.p for r in df.select(context.preview(F.col("d"), F.col("t"), F.col("u"), F.col("c"), 750).alias("p")).collect()]
    assert got == [clean(long), clean(long), "", clean(long), "", ""]


def test_pack_cuts_the_last_block(spark):
    rows = [("r", k, k, "word " * 200, f"t{k}", f"http://s{k}", "", "", "", 1.0) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "run string, position int, id int, document string, title string, url string, source_type string, contexts string, parent_id string, score double")
    got = context.pack(df, 2000).orderBy("index").collect()
    whole = len("[1] t1\nURL: http://s1\n") + 700 - 1
    assert len(got) == 3 and len(got[0].block) == len(got[1].block) and abs(len(got[0].block) - whole) <= 1 and len(got[2].block) <= 2000 - 2 * len(got[0].block)
    assert len(context.pack(df, 1000).collect()) == 1


def test_pages(spark):
    text = "Buy now.\nModel X | input $2.50 | output $10\nModel X | input $2.50 | output $10\nfooter $3 model\n" + "The transformer is here. Nothing. " * 3
    r = spark.createDataFrame([(text,)], "t string").select(pages.price_rows(F.col("t")).alias("r"), pages.price_facts(F.col("t")).alias("f"), pages.key_sentences(F.col("t")).alias("k"), pages.price_sections(F.col("t")).alias("s")).first()
    assert r.r == ["Model X | input $2.50 | output $10"] and all("$" in x for x in r.f) and "The transformer is here" in r.k and r.s
    body = "Start of it all. " + "Filler text goes on. " * 40 + "The equation f(x) = 3 gives a score of 91.5 % here. " + "More text follows now. " * 40
    (x, *_), = spark.createDataFrame([(body,)], "t string").select(pages.signal_snippets(F.col("t"))).first()
    assert "equation f(x) = 3" in x.snippet and x.snippet.endswith(".") and x.snippet[0].isupper() and x.score >= 10


def test_competitor_tasks(spark):
    plans = spark.createDataFrame([(1, ["ACME", "Beta"], ["What are the pricing tiers of each company?", "Is there a free tier?", "How fast is growth?", ""])], "plan int, companies array<string>, questions array<string>")
    tasks = spark.createDataFrame([(1, "acme", "growth figures", "find", ["x"])], "plan int, target_name string, query_context string, extraction_goal string, expected_signals array<string>")
    got = sorted((r.company, r.topic) for r in planner.competitor_tasks(plans, tasks).collect())
    assert got == [("ACME", "pricing tiers"), ("Beta", "fast growth"), ("Beta", "pricing tiers")]


def test_semantic_slabs(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [None] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id < 12").select(F.col("id").alias("query_id"), "v")
    one = retrieval.semantic(df, asked, 5).collect()
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    assert sorted(one) == sorted(retrieval.semantic(df, asked, 5).collect()) and len(one) == 60
    assert all(r.score == 1.0 for r in one if r.rank == 1)
    assert retrieval.semantic(df, asked.limit(0), 5).count() == 0


def test_line_diff(spark):
    a, b = "x\nthe price is 1\nwater here\nsame", "x\nthe price is 2\nwater there\nsame\nplain"
    got = [(r.sign, r.line) for r in changes.line_diff(spark.createDataFrame([("u", a, b)], "url string, previous string, current string"), objective="some water").orderBy("sign", "place").collect()]
    want = [x for x in difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="") if x[0] in "+-" and not x.startswith(("+++", "---")) and ("price" in x or "water" in x)]
    assert sorted(got) == sorted((x[0], x[1:]) for x in want)


def test_chunk_store(spark, tmp_path):
    store = connectors.ChunkStore(spark, f"file://{tmp_path}/store")
    schema = "history_key string, url string, chunk string"
    typed = spark.createDataFrame([], schema).schema
    store.write(spark.createDataFrame([("k", "a", "1"), ("k", "a", "2"), ("k", "b", "3"), ("j", "a", "4")], schema))
    store.write(spark.createDataFrame([("k", "a", "5")], schema))
    store.write(spark.createDataFrame([("k", "a", "5")], schema))
    assert sorted(r.chunk for r in store.read(typed).collect()) == ["3", "4", "5"]
    store.delete(spark.createDataFrame([("k", "b")], "history_key string, url string"))
    assert sorted(r.chunk for r in store.read(typed, "k").collect()) == ["5"]


def test_upsert_buckets(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id long, at long, x string"
    write = feeds.upsert(path, "id", "at", 4)
    write(spark.createDataFrame([(i, 1, "old") for i in range(20)], schema), 0)
    for _ in range(2):  # a batch that runs again
        write(spark.createDataFrame([(3, 2, "new"), (30, 1, "first"), (4, 0, "late")], schema), 1)
    write(spark.createDataFrame([(3, 3, "newer")], schema), 2)
    got = {r.id: r.x for r in feeds.current(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert len(got) == 21 and got[3] == "newer" and got[30] == "first" and got[4] == "old"
    assert all(len(v) <= 2 for v in feeds.versions(spark, path).values())


def test_last_n_stream(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i:02d}:00", i) for i in range(40)]
    schema = "user_id long, ts timestamp, event_id long"
    spark.createDataFrame(rows, "user_id long, ts string, event_id long").selectExpr("user_id", "cast(ts as timestamp) ts", "event_id").coalesce(1).write.json(f"{tmp_path}/in")
    made = feeds.last_n_stream(feeds.read_json(spark, f"{tmp_path}/in", schema), 4)
    made.writeStream.format("memory").queryName("last_n").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    got = {(r.user_id, r.place): r.event_id for r in spark.table("last_n").collect()}
    assert got == {(u, k + 1): e for u in range(3) for k, e in enumerate(sorted((e for w, _, e in rows if w == u), reverse=True)[:4])}


def test_connectors(spark, tmp_path):
    cases = connectors.eval_cases([{"query": " a  b ", "relevant_ids": "x, y", "relevant_urls": ["u", ""]}, {"query": ""}])
    assert cases == [{"query": "a b", "relevant_ids": ["x", "y"], "relevant_urls": ["u"], "history_key": ""}]
    assert connectors.enabled({"s": {"required": ["K"]}}, "s", {"K": "1"}.get) and not connectors.enabled({"s": {"required": ["K"]}}, "s", {}.get) and not connectors.enabled({"s": {"enabled": False}}, "s")
    path = connectors.write_report(" text ", "My Goal!", str(tmp_path))
    assert path.endswith("my-goal.md") and open(path).read() == "text\n"
    held = connectors.Pages(spark.createDataFrame([("HTTP://A.org/x?y", "<title>T</title><p>body</p>")], "url string, html string"))
    got = {r.url: (r.title, r.alive) for r in held.fetch(spark.createDataFrame([("http://a.org/x",), ("http://a.org/z",)], "url string")).collect()}
    assert got == {"http://a.org/x": ("T", True), "http://a.org/z": ("", False)}
    messages = [{"role": "user", "content": "x" * 400}]

    class Busy:
        n = 0

        def complete(self, m):
            self.n += 1
            if self.n < 2:
                raise ValueError("rate limit")
            return str(len(m[0]["content"]))

    assert int(connectors.complete_with_retries(Busy(), messages)) < 400 and len(messages[0]["content"]) == 400


def test_timed_stream_equals_batch(spark, tmp_path):
    """Late and repeated events, superseded starts, starts that time out: the stream's rows are the batch's."""
    import datetime as dt
    import random

    from sievewright.streaming import feeds

    rng = random.Random(8)
    zero = dt.datetime(2024, 1, 1)
    rows = [(i, zero + dt.timedelta(microseconds=rng.randrange(0, 4 * 3600 * 10**6)), rng.randrange(4), rng.choice(["agent_started", "agent_completed", "agent_failed", "other"])) for i in range(150)]
    rows.sort(key=lambda r: r[1])
    end = [(10_000 + u, zero + dt.timedelta(hours=9), u, "agent_started") for u in range(4)] + [(20_000 + u, zero + dt.timedelta(hours=20), u, "agent_completed") for u in range(4)]  # moves the watermark on
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    fed = []
    for n in range(0, 150, 30):
        part = rows[n : n + 30] + rng.sample(rows[max(0, n - 8) : n + 30], 4)  # stragglers' places and repeats
        rng.shuffle(part)
        fed.append(part)
    for n in range(len(fed) - 1):  # each file lends its last rows to the next one, within the watermark's delay
        fed[n], fed[n + 1] = fed[n][:-3], fed[n + 1] + fed[n][-3:]
    for n, part in enumerate([*fed, end[:4], end[4:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kept = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stream = feeds.timed_stream(feeds.events(kept, "3 hours"), 300.0)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, feeds.timed(spark.createDataFrame(rows + end, schema), 300.0).collect()))
    assert got == want, (sorted(set(got) - set(want)), sorted(set(want) - set(got)))
    assert {r[2] for r in want} == {"agent_completed", "agent_failed", "timed_out"}


def test_history_stream(spark, tmp_path):
    """Changes over three runs: soft deletes keep their hash, sources return, a batch that runs again does no harm."""
    from sievewright.streaming import feeds

    sink = feeds.upsert(f"file://{tmp_path}/history", "url", "at", 4, feeds.history_of)
    runs = [[("a", "added", "h1", 1), ("b", "added", "h2", 1)], [("a", "removed", None, 2), ("b", "changed", "h3", 2), ("c", "unchanged", "x", 2)], [("a", "added", "h4", 3), ("b", "removed", None, 3)]]
    for n, rows in enumerate(runs):
        batch = feeds.history_changes(spark.createDataFrame(rows, "url string, change string, content_hash string, at int"))
        sink(batch, n)
        sink(batch, n)
    held = feeds.current(spark, f"file://{tmp_path}/history", batch.schema)
    assert sorted(map(tuple, held.collect())) == [("a", "h4", True, 3), ("b", "h3", False, 3)]


def test_lexical_index(spark, tmp_path):
    """Scopes with statistics of their own, several blocks, a stored index, pruning: the scores of a plain BM25; null scopes, texts and ids, ties, an empty table."""
    import math
    import random
    from collections import Counter

    from sievewright.operators import lexical

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"s{i % 3}", i, " ".join(rng.choice(words[: rng.choice([6, 60])]) for _ in range(rng.randint(0, 40)))) for i in range(900)]
    odd = [(None, 1_000, "w1"), ("s0", 1_001, None), ("s1", 1_002, ""), ("s2", 1_003, docs[2][2])]
    asked = [(q, f"s{q % 3}", " ".join(rng.choice(words) for _ in range(30))) for q in range(12)] + [(50, "none", "w1"), (51, "s0", "unknown"), (52, "s0", None)]
    frame = spark.createDataFrame(docs + odd, "scope string, id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, scope string, text string")
    want = {}
    for q, scope, text in asked:
        held = {i: (t or "").split() for s, i, t in docs + odd if s == scope}
        df = Counter(w for t in held.values() for w in set(t))
        avg = sum(map(len, held.values())) / max(1, len(held))
        told = {}
        for i, t in held.items():
            tf = Counter(t)
            score = sum(n * math.log((len(held) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, n in Counter((text or "").split()).items() if tf[w])
            if score:
                told[i] = round(score, 6)
        best = sorted((-s, i) for i, s in told.items())[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    for index in (lexical.build(frame), lexical.build(frame, lexical.vocabulary(queries), f"file://{tmp_path}/index")):
        got = {(r.query_id, r.rank): (r.id, r.score) for r in lexical.search(index, queries, 5).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    read = lexical.reading(index, queries, 5).agg(F.sum("postings").alias("p"), F.sum("summed").alias("s"), F.sum("looked_up").alias("l")).first()
    assert read.s + read.l < read.p
    assert lexical.search(lexical.build(frame.limit(0)), queries, 5).count() == 0


def test_rerank_order(spark):
    """The first rows in the order of the blend, those that the scorer leaves out with 0, the others after them as they were."""
    from sievewright.operators import hybrid

    rows = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "c", 3, 0.7), (1, "d", 4, 0.95), (1, "e", 5, 0.1), (2, "z", 1, 0.5)], "query_id int, id string, rank int, score double")
    told = spark.createDataFrame([(1, "c", 0), (1, "a", 1), (2, "z", 0)], "query_id int, id string, place int")
    made = hybrid.rerank(rows, ["query_id"], lambda first, by: told, top=3, weight=0.7)
    got = [(r.query_id, r.id, round(r.score, 6)) for r in made.orderBy("query_id", "rank").collect()]
    assert got == [(1, "c", 0.91), (1, "a", 0.27), (1, "b", 0.24), (1, "d", 0.95), (1, "e", 0.1), (2, "z", 0.85)]
    assert hybrid.rerank(rows.limit(0), ["query_id"], lambda first, by: told).count() == 0


def test_texts_in_nested_values(spark):
    from sievewright.functions import urls as U

    rows = [(("at http://A.com/x/, and", [("http://b.com/y?q=1", None), (None, ["(http://c.com)", "http://a.com/x"])], {"k": "https://arxiv.org/abs/1234.56789v2."}, 3),), ((None, None, None, None),), (None,)]
    df = spark.createDataFrame(rows, "p struct<o: string, t: array<struct<u: string, s: array<string>>>, m: map<string, string>, n: int>")
    got = [r.u for r in df.select(U.extracted(U.leaves(F.col("p"), df.schema["p"].dataType)).alias("u")).collect()]
    assert got == [["http://a.com/x", "http://b.com/y", "http://c.com", "https://arxiv.org/pdf/1234.56789"], [], []]


def test_quick_patterns_and_cleaning(spark):
    """Faster patterns have the same matches; cleaning has the same results."""
    rows = ["", " ", "a", "x  y\t z w  v\x85u\x1cq", "f(x) = y, 3.5 % F1 12ms 7tokens/s a_b.c(d) _x (1) =", "Definition; défined  as; DEFINED\tas o(n) O(N) πrate rate2 2rate -rate scoré ſcore ́rate", "a.b.c d . e foo.bar (z)=", "\\frac ∑ Σ softmax(x) = μ Μ ſqrt sqrt2 log exp-log", "é(x) éa(x)=1 aé.b x" * 3]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, t string")
    for p in (pages.SIGNAL, pages.FORMULA, pages.METRIC, pages.CALL):
        pairs = df.select(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(pages.quick(p)), F.lit(0)).alias("b")).collect()
        assert all(r.a == r.b for r in pairs) and any(r.a for r in pairs)
    assert all(r.a == r.b for r in df.select(T.clean(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b")).collect())
    both = df.select(pages.starts(F.col("t"), pages.quick(pages.SIGNAL)).alias("a"), F.transform(pages.places(F.col("t"), pages.SIGNAL), lambda x: x["start"]).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_signal_snippets_once(spark):
    """A source's snippets are made once, not for a filter and again; candidates end the search, also where passages before them are no evidence."""
    body = "Score. " * 3 + ("Nothing to tell here at all, but words go on and on for a while. " * 3 + "The score of it was 12 % in the end. ") * 60
    df = spark.createDataFrame([(1, 0, "http://a", "", body), (1, 1, "http://b", "", "score"), (1, 2, "http://c", "", " ")], "run int, position int, url string, title string, content string")
    made = pages.signal_results(df, ["run"])
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z0-9_]+") == 1
    (found,) = df.select(pages.signal_snippets(F.col("content"))).first()
    assert [x.score for x in found] == [2, 2] and [r.url for r in made.collect()] == ["http://a"]  # passages that begin alike count once


def test_index_of_cut_words(spark):
    """Words that are cut down to the asked ones, with a text's own length, score as the text does."""
    from sievewright.operators import lexical

    texts = [(k, "S", " ".join(f"w{(k * j) % 7} x{j % 3}" for j in range(1 + k % 5))) for k in range(40)] + [(40, "S", "")]
    docs = spark.createDataFrame(texts, "id long, scope string, text string")
    queries = spark.createDataFrame([(0, "S", "w1 w2 x1 absent")], "query_id int, scope string, text string")
    cut = docs.select("id", "scope", F.filter(T.tokens(F.col("text")), lambda t: t.isin("w1", "w2", "x1")).alias("words"), F.size(T.tokens(F.col("text"))).alias("length"))
    whole, few = (sorted(map(tuple, lexical.search(lexical.build(d), queries, 9).collect())) for d in (docs, cut))
    assert whole == few and len(few) == 9


def test_url_coverage_moves_few_texts(spark, monkeypatch):
    """What is dealt to targets and indexed there are words of their queries, not texts."""
    from sievewright.operators import hybrid, lexical

    targets = spark.createDataFrame([(1, o, f"http://{o % 3}", "alpha beta" if o < 2 else "") for o in range(6)], "run int, ordinal int, url string, query string")
    chunks = spark.createDataFrame([(k, [f"http://{k % 3}", "http://1"], k, f"alpha {'beta ' * (k % 4)} text {k}", 0.5) for k in range(30)], "id long, urls array<string>, chunk_index int, document string, authority double")
    seen = []
    build = lexical.build
    monkeypatch.setattr(lexical, "build", lambda docs, *more: seen.append(docs) or build(docs, *more))
    got = [(r.place, r.url, r.bm25_rank, r.id) for r in hybrid.url_coverage(targets, chunks, 2).orderBy("place").collect()]
    (docs,) = seen
    assert {w for r in docs.collect() for w in r.words} == {"alpha", "beta"} and "text" not in docs.columns
    assert got == [(1, "http://0", 1, 3), (2, "http://0", 2, 15), (3, "http://1", 1, 7), (4, "http://1", 2, 11)]


def test_index_blocks_are_bounded_in_words(spark):
    """A block takes so many words at most, so that long documents don't make it larger; one document is never cut."""
    from sievewright.operators import lexical

    docs = spark.range(6_000).coalesce(1).select(F.lit("").alias("scope"), "id", F.repeat(F.lit("a b c d "), 50).alias("text"))
    docs = docs.unionByName(spark.range(6_000, 6_001).select(F.lit("").alias("scope"), "id", F.repeat(F.lit("z "), lexical.WORDS + 1).alias("text")))
    index = lexical.build(docs).filter("term = ''")
    found = [(r.n, sum(r.tf)) for r in index.collect()]
    assert sum(n for n, _ in found) == 6_001 and all(words <= lexical.WORDS or n == 1 for n, words in found)


def test_counts_and_signals_once(spark):
    """Counts of cleaned texts and guarded signals are those of the plain forms; a block is cleaned once, not at each use in the fold."""
    rows = [*TEXTS, "", " ", "one", " one\t two \n", "a = bcdef", "a =b", "x=abcd", "class Foo", "softmax", "f(x) is", "tf. x", "no", "= = = ="]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = F.size(F.filter(F.split(T.clean(F.col("t")), " "), lambda x: x != ""))
    told = df.select(T.token_count(F.col("t")).alias("a"), plain.alias("b"), T.has_signal(F.col("t")).alias("c"), F.col("t").rlike(T.SIGNAL).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in told) and {r.d for r in told} >= {True, False}
    plan = df.select(chunking.packed(chunking.blocks(F.col("t")), 100))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s+") < 20
