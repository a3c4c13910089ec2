import re

from pyspark.sql import functions as F

from sievewright.operators import upkeep


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_status(spark):
    a = spark.createDataFrame([("t1", "success"), ("t2", "failed"), ("t3", None)], "task string, status string")
    b = spark.createDataFrame([("t1", " partial "), ("t2", "failed"), ("t4", "success")], "task string, status string")
    assert rows(upkeep.status_changes(a, b, "task", "status")) == [("t1", "success", "partial")]
    made = spark.createDataFrame([(0, 1), (2, 0), (2, 3), (None, None)], "s int, e int").select(upkeep.task_status(F.col("s"), F.col("e")))
    assert [r[0] for r in made.collect()] == ["failed", "success", "partial", "failed"]


def test_alignment(spark):
    df = spark.createDataFrame([(1, "Water here"), (1, "none"), (2, None)], "g int, t string")
    assert rows(upkeep.alignment(df, ["g"], F.col("t"), "of water")) == [(1, 2, 1, "partial"), (2, 1, 0, "weak")]
    assert {r.alignment for r in upkeep.alignment(df, ["g"], F.col("t"), "of an").collect()} == {"unknown"}


def test_valid_query(spark):
    df = spark.createDataFrame([("query 1",), ("search query 12",), ("how does it work",), ("two words",), (None,)], "t string")
    assert [r[0] for r in df.select(upkeep.valid_query(F.col("t"))).collect()] == [False, False, True, False, False]


def test_scopes_against_all_pairs(spark):
    import random

    from sievewright.operators import scopes

    rng = random.Random(3)
    words = [f"word{i}" for i in range(25)] + ["Cultures", "cultural", "Indian", "policies", "the", "of", "is"]
    texts = {i: " ".join(rng.choice(words[: rng.choice([5, 32])]) for _ in range(rng.randint(0, 12))) for i in range(80)} | {80: None, 81: "", 82: "of the"}
    df = spark.createDataFrame([(i, f"k{i % 60}", t) for i, t in texts.items()], "id int, history_key string, objective string")
    sets = {r.id: set(r.t) for r in df.select("id", scopes.objective_tokens(F.col("objective")).alias("t")).collect()}
    assert not sets[82] and not sets[80] and {"culture", "india", "policy"} >= {x for s in sets.values() for x in s if not x.startswith("word")}
    want = set()
    for a in sets:
        mine = []
        for b in sets:
            c = len(sets[a] & sets[b])
            if a % 60 != b % 60 and c and (score := max(c / len(sets[a] | sets[b]), c / min(len(sets[a]), len(sets[b])))) >= 0.4:
                mine.append((-score, (texts[b] or "").lower(), f"k{b % 60}"))
        mine = sorted(set(mine))
        want |= {(a, 1, f"k{a % 60}", 1.0)} | {(a, n + 2, k, round(-s, 9)) for n, (s, _, k) in enumerate(mine[:5])}
    got = {(r.id, r.place, r.history_key, round(r.similarity, 9)) for r in scopes.history_scopes(df, df).collect()}
    assert got == want and len(want) > 200
    assert scopes.history_scopes(df.limit(0), df).count() == 0 and scopes.history_scopes(df, df.limit(0)).count() == 83


def test_index_runs(spark, tmp_path):
    """A run writes its own version, running it again changes nothing, a later run skips what is fresh and keeps what it doesn't see."""
    from sievewright.operators import indexing
    from sievewright.store_queries import _split

    path = f"file://{tmp_path}/index"
    none = spark.createDataFrame([], "url string, change string")
    records = lambda rows: spark.createDataFrame([("k", u, c, str(hash(c))) for u, c in rows], "history_key string, url string, content string, content_hash string")
    one = indexing.write(path, 1, records([("a", "x y z"), ("b", "w " * 1300), ("c", "")]), none, _split, first_run=True).first()
    assert (one.indexed_sources, one.indexed_chunks, one.stored_chunks, one.skipped_sources, one.total_sources_seen) == (2, 3, 3, 1, 3)
    again = indexing.write(path, 1, records([("a", "x y z"), ("b", "w " * 1300), ("c", "")]), none, _split, first_run=True).first()
    assert again == one and indexing.versions(spark, path) == [1]
    change = spark.createDataFrame([("b", "changed"), ("z", "removed"), (None, None)], "url string, change string")
    two = indexing.write(path, 2, records([("b", "new text"), ("d", "more")]), change, _split).first()
    assert (two.indexed_sources, two.stored_chunks, two.deleted_changed_sources, two.preserved_removed_sources, two.skipped_sources) == (2, 3, 1, 1, 0)
    chunks, parents = indexing.read(spark, path)
    assert sorted((r.url, r.document, r.change_status) for r in chunks.collect()) == [("a", "x y z", "indexed"), ("b", "new text", "changed"), ("d", "more", "unchanged")]
    assert sorted(r.url for r in parents.collect()) == ["a", "b", "d"] and chunks.join(parents, "parent_id").count() == 3
    assert indexing.write(path, 3, records([("b", "new text")]), none, _split).first().skipped_sources == 1
    told = spark.createDataFrame([("success", 0, 12), ("success", 0, 0), (None, 1, 1), ("failed", 1, 1)], "s string, i int, c int")
    assert [r.p for r in told.select(indexing.problems(F.col("s"), F.col("i"), F.col("c")).alias("p")).collect()] == [[], ["rag_index indexed zero chunks"], ["rag_index status is missing"], ["rag_index status is failed"]]


def test_parents(spark):
    hits = spark.createDataFrame([(1, 10, 1, "a b", 5), (1, 11, 2, "c", 5), (1, 12, 3, "d e f", 6), (1, 13, 4, "g", None)], "query_id int, id int, rank int, document string, parent_id int")
    parents = spark.createDataFrame([(5, "a b c"), (6, "d e")], "parent_id int, content string")
    found = rows(upkeep.expand_parents(hits, parents).select("id", "document", "expanded"))
    assert found == [(10, "a b c", True), (12, "d e f", False), (13, "g", False)]


def test_coverage(spark):
    old = spark.createDataFrame([("What is it?", "gap", 0), ("Why?", "gap", 1), ("?", "gap", 2)], "question string, status string, position int")
    new = spark.createDataFrame([("what is it", "partial", 0), ("What is  it!", "covered", 1), ("New one", "covered", 2), ("!", "covered", 3)], "question string, status string, position int")
    found = [tuple(r) for r in upkeep.merge_coverage(old, new).orderBy("appended", "position").select("question", "status").collect()]
    assert found == [("What is  it!", "covered"), ("Why?", "gap"), ("?", "gap"), ("New one", "covered")]


def test_citations_and_context(spark):
    df = spark.createDataFrame([("[1] a [2][9] b",), ("none",), (None,)], "t string")
    places = F.create_map(F.lit("1"), F.lit("2"), F.lit("2"), F.lit("1"))
    assert [r[0] for r in df.select(upkeep.remap_citations(F.col("t"), places)).collect()] == ["[2] a [1][9] b", "none", None]
    a, b = (spark.createDataFrame(x, "id int, rank int") for x in ([(1, 2), (2, 1)], [(2, 9), (3, 1)]))
    assert rows(upkeep.merge_context([a, b]).select("id", "rank")) == [(1, 2), (2, 1), (3, 1)]
    assert rows(upkeep.missing_urls(a.withColumn("url", F.col("id")), b.withColumn("url", F.col("id"))).select("id")) == [(1,)]


def test_latest(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), (None, 1, "c")], "url string, p int, x string")
    assert [tuple(r) for r in upkeep.latest(df, "url", "p").orderBy("x").collect()] == [("u", 2, "b"), (None, 1, "c")]


def test_parent_texts(spark):
    """Every hit against its real chunk and parent window: both branches are reached and the text is the one with more tokens."""
    import hashlib

    from sievewright import store_queries
    from sievewright.operators import chunking

    sf = "/root/testdata/sf0.001"
    got = store_queries.parent_expansion_texts(spark, sf).collect()
    docs = {r.doc_id: " ".join((r.text or "").split()).split(" ") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    count = lambda x: len(re.findall("[a-z0-9_]+", x.lower()))
    window = lambda name, size, overlap: " ".join(docs[int(name.split("-")[0])][(a := int(name.split("-")[1]) * (size - overlap)) : a + size])
    for r in got:
        child, parent = window(r.id, chunking.SIZE, chunking.OVERLAP), window(r.parent_id, chunking.PARENT_SIZE, chunking.PARENT_OVERLAP)
        assert r.expanded == (count(parent) > count(child))
        assert r.text_hash == hashlib.sha256((parent if r.expanded else child).encode()).hexdigest()
    assert {r.expanded for r in got} == {True, False}
    shown = [(r.query_id, r.parent_id) for r in got if r.expanded]
    assert len(shown) == len(set(shown))


def test_scopes_in_parts(spark, monkeypatch):
    """Many equal objectives of one key hide no other key's, and parts of any size give the same rows."""
    from sievewright.operators import scopes

    rows = [(i, "own", f"alpha, {'.' * i}beta") for i in range(20)] + [(20 + i, f"k{i:02}", f"alpha-beta{'.' * i}" if i < 3 else f"beta alpha gamma{i % 3} delta{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, history_key string, objective string")
    got = lambda: sorted(map(tuple, scopes.history_scopes(df.filter("id % 7 = 0"), df).select("id", "place", "history_key", "objective", "similarity").collect()))
    whole = got()
    assert [r[2] for r in whole if r[0] == 0][:4] == ["own", "k00", "k01", "k02"]
    monkeypatch.setattr(scopes, "ASKED", 3)
    monkeypatch.setattr(scopes, "HELD", 5)
    assert got() == whole and {r[1] for r in whole} == {1, 2, 3, 4, 5, 6}
