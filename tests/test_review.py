import re

from pyspark.sql import functions as F

from sievewright import review_queries
from sievewright.operators import review

SF = "/root/testdata/sf0.001"


def each(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def brute_figures(report):
    """The same rule, number by number, by what stands around each."""
    found = []
    for line in report.split("\n"):
        plain = " ".join(re.sub(r"\[\d+\]", "", re.sub(r"[*_#|]+", " ", re.sub(r"`([^`]*)`", r"\1", line))).split())
        if line.lstrip().startswith("#") or re.sub(r"[^a-z]+", " ", plain.lower()).strip() in ("references", "reference", "sources"):
            continue
        if "%" not in plain and not re.search(r"\b(benchmark|bleu|glue|imagenet|accuracy|top[- ]?[15]|f1|auc|rouge)\b", plain.lower()):
            continue
        for m in re.finditer(r"\b\d+(?:\.\d+)?\s*%?", plain):
            before, after, value = plain[: m.start()], plain[m.end() :], " ".join(m.group().split())
            if before.endswith(("-", "[")) or re.fullmatch(r"(19|20)\d\d", value):
                continue
            if not value.endswith("%") and (before.endswith((".", "_", "/")) or after.startswith(("-", ".", "_", "/"))):
                continue
            if value not in found:
                found.append(value)
    return found


LINES = ["accuracy 91.5 % and 3.14.5% of 2021, v1.2-3 f1 7/8 [2] [12", "# accuracy 5", "no figures 5", "`BLEU` **28.4**, 28.4 top-1 9-10 1.", "References", "", None, "12 - 5% x_3 % 4"]


def test_figures(spark):
    got = each(spark, review.figures, *LINES)
    assert got[0] == brute_figures(LINES[0]) and got == [brute_figures(x) if x is not None else None for x in LINES]
    rows = spark.createDataFrame([("accuracy 5 and 6", "a 5"), ("accuracy 5", ""), ("accuracy 5", None), ("", "x")], "r string, e string")
    assert [r[0] for r in rows.select(review.unsupported(F.col("r"), F.col("e"))).collect()] == [["6"], [], [], []]


def test_figures_query(spark):
    rows = review_queries.report_figures(spark, SF).collect()
    texts = {r.doc_id: re.sub("the ", "the 7.5 ", re.sub(r"tion\. ", "tion. Accuracy 91.5 % in 2021, v1.2-3 and top-1 ", r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and any(r.figures for r in rows)
    for r in rows:
        evidence = " ".join(re.sub(r"\[\d+\]", "", re.sub(r"[*_#|]+", " ", re.sub(r"`([^`]*)`", r"\1", texts[r.doc_id][:400]))).split()).lower()
        report = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", texts[r.doc_id])).strip()
        assert r.figures == " ".join(x for x in brute_figures(report) if evidence and x not in evidence)


def test_headings(spark):
    assert each(spark, review.normal_heading, "1. **A–b** [3] `c`!", None) == ["a b c", ""]
    assert each(spark, review.titles, "# A #\n```\n# no\n```\n ## 2) B\n#C\n```\n# open", "", "text") == [["a", "b"], [], []]
    got = each(spark, review.question_heading, "What are the results of GLUE?", "how (big) iPhone sales.", "why?", None)
    assert got == ["The Of GLUE", "Big iPhone Sales", "Why", "Research Finding"]
    pairs = spark.createDataFrame([("cost of models", "cost"), ("alpha beta gamma", "beta and gamma"), ("alpha beta gamma", "beta"), ("alpha", "omega"), ("the of", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(review.alike(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


def test_gap_items(spark):
    text = "| Requirement | Status |\n|---|---|\n| Price [1] | Missing | none found |\n| Speed | ok | fine |\n| Size | covered | missing evidence here |\nNo explicit `cost` **given**\nno explicit cost given\nfine"
    assert each(spark, review.gap_items, text, "", None) == [["Price none found", "Size missing evidence here", "No explicit cost given"], [], []]
    assert each(spark, review.requirements, "do: (1) one, and 2. two; 3) One.", "x\n- a\n* b\n-  A", "whole  text", " ", None) == [["one", "two"], ["a", "b"], ["whole text"], [], []]
    assert each(spark, review.gap_notes, "fine\nA **gap** [1] here\na gap  here", None) == [["A gap here"], []]


def test_issues(spark):
    reports = spark.createDataFrame([(1, "# Executive summary\nBERT wins with accuracy 93.2 [1] [4]\n## Context\n## Open questions\n## Conclusion\n## Cross-cutting analysis\n## References"), (2, None), (3, "x")], "run int, report string")
    questions = spark.createDataFrame([(1, 1, "What is BERT?"), (1, 2, "How does Llama differ?"), (1, 3, " "), (1, 4, None), (9, 1, "lost?")], "run int, number int, question string")
    sources = spark.createDataFrame([(1, 1, "http://a")], "run int, index int, url string")
    evidence = spark.createDataFrame([(1, "an accuracy of 90"), (2, "x")], "run int, evidence string")
    got = {}
    for r in review.issues(reports, questions, sources, evidence).orderBy("run", "place").collect():
        got.setdefault(r.run, []).append(r.issue)
    assert got[1] == ["report uses unavailable citations: [4]", "report includes benchmark metrics not present in evidence: 93.2", "missing planner topic section: BERT", "missing planner topic section: Llama Differ", "missing planner topic: How does Llama differ?"]
    assert got[2][0] == "report is empty" and len(got[2]) == 7
    assert got[3][0] == "report must include a References section" and len(got[3]) == 7 and [x[:21] for x in got[9]] == ["missing planner topic"] * 2
    none = review.issues(reports.limit(0), questions.limit(0), sources.limit(0), evidence.limit(0))
    assert none.collect() == []


def test_finished(spark):
    reports = spark.createDataFrame([(1, "## # A [3] b [9]\n## References\n[9] old\n## B\n[1] x"), (2, "plain"), (3, None), (4, "a [2]")], "run int, report string")
    sources = spark.createDataFrame([(1, 1, "http://a"), (1, 3, " http://c "), (2, 1, "http://z")], "run int, index int, url string")
    got = {r.run: r.report for r in review.finished(reports, sources).collect()}
    assert got[1] == "## A [3] b\n## B\n[1] x\n\n## References\n[3] http://c\n[1] http://a"
    assert got[2] == "plain\n\n## References\nNo cited source markers were used." and got[3].startswith("## References") and got[4] == "a [2]\n\n## References"


def test_payloads(spark):
    rows = spark.createDataFrame([(1, "a", "A ", "text", 2), (2, None, "b", " ", 0), (3, "c", None, "see REFERENCES", None)], "run int, objective string, planned string, report string, n_sources int")
    got = [(r.run, r.problem) for r in review.payload_problems(rows, "report_node", "report").orderBy("run", "place").collect()]
    section = "report_node report must include a References section"
    assert got == [(1, section), (2, "report_node payload.objective does not match research_plan.objective"), (2, "report_node payload.report is required"), (2, section)]
    got = [(r.run, r.problem.split(".")[-1]) for r in review.payload_problems(rows.withColumnRenamed("report", "synthesis"), "synthesis_node", "synthesis").orderBy("run", "place").collect()]
    assert got == [(2, "objective is required"), (2, "objective"), (2, "synthesis is required"), (2, "sources is required"), (3, "sources is required")]
    runs, sources = spark.createDataFrame([(1,), (2,), (3,)], "run int"), spark.createDataFrame([(1, "u", "t"), (2, "u", None)], "run int, url string, full_content string")
    assert sorted((r.run, r.problem) for r in review.browser_problems(runs, sources).collect()) == [(2, "browser_node produced no useful sources"), (3, "browser_node produced no browser_results")]
