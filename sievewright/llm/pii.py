"""Personal data: base patterns, and a span classifier trained by weak supervision.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test. Looser patterns propose
further candidates, and those of one more kind that has no base: secrets, such as keys and tokens in an assignment. Five labelers vote on every candidate (yes, no, or abstain): the strict pattern, a gazetteer (top
level domains, issuer digits, address blocks, country codes), cue words in the context before it, a structural test
(checksum, ranges, digit counts), and clean edges. Expectation-maximisation estimates each labeler's reliability for each kind from
the counts of vote patterns, and a logistic classifier is fitted to the resulting probabilities over votes, kind and
length. A candidate is added if the classifier gives at least SURE and no base span overlaps it; base spans stay. Of added
spans that overlap, the one that starts first stays, then that of the first kind; two alike count once.

Everything that reads texts is SQL functions. The vote patterns are at most 5 * 3**5 * 2 rows whatever the corpus, and
only these counts reach the driver. Patterns are written so that no run of characters is scanned more than twice
(possessive, with starts tied to the edge of a run), with the same matches as the plain ones.

Defined cases: null text counts as empty and has no spans; texts of any length; repeated rows are treated alike; with no
candidates at all nothing is added; extra columns are ignored by find() and kept by mask(), which sets n_chars to the
new length if there is such a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

KINDS = ("email", "ip", "card", "phone", "secret")
SURE = 0.9
CONTEXT = 32
ROUNDS = 30
LABELERS = 5
NO_SPANS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,long:int>>"

#: Base patterns in linear form.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
#: What a text must hold for a pattern to be tried.
HINT = {
    ("email", True): "@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): r"[0-9](?:[\x20-]?[0-9]){12}", ("phone", True): r"\+[0-9]",
    ("email", False): r"[\[(]at[\])]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", ("card", False): r"[0-9](?:[\x20-]?[0-9]){12}", ("phone", False): r"[0-9]{3}[.-][0-9]{4}",
    ("secret", False): r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20}",
}
#: Fixed word lists of the gazetteer and of the context labeler.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|uk|de|fr|es|it|nl|ch|at|be|se|no|dk|fi|pl|pt|ie|us|ca|mx|br|ar|cl|co|au|nz|jp|cn|kr|in|ru|za"
CUES = {
    "email": "mail|contact|write to|reach|correo|courriel|schreib", "ip": r"\bip\b|address|host|server|login|logged|adresse|client",
    "card": "card|visa|master|credit|debit|payment|tarjeta|carte|karte", "phone": "tel|phone|call|fax|mobile|cell|whatsapp|anruf|appel|llam",
    "secret": "token|secret|passw|pwd|key|auth|bearer|credential|clave|jeton",
}
AGAINST = {"email": "npm|git@|import", "ip": r"version|release|\bv\.?\s*$|section|build", "card": "isbn|order|invoice|serial|sku|tracking", "phone": "isbn|order|invoice|serial|version|section", "secret": "sha|commit|md5|checksum|digest|hash|uuid|etag|https?:"}


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Matches as (start, end, s), in code points; between two matches stands one part of the split."""
    found = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")

    def place(m: Column) -> Column:
        steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("p"), m.alias("m"))

        def step(s: Column, z: Column) -> Column:
            start = s["at"] + F.length(z["p"])
            end = start + F.length(z["m"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), z["m"].alias("s")))).alias("out"))

        return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda s: s["out"])

    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(place(m)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def add(a: Column, i: Column) -> Column:
        x = F.ascii(F.substr(d, i, F.lit(1))) - 48
        twice = x * 2
        return a + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def _parts_fit(s: Column) -> Column:
    return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def _passes(kind: str, s: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        return _parts_fit(s)
    if kind == "card":
        return _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _gazetteer(kind: str, s: Column) -> Column:
    """True, false, or null to abstain."""
    if kind == "email":
        return F.lower(s).rlike(rf"(?:\.|\[dot\]|\(dot\))\x20?(?:{DOMAINS})$")
    if kind == "ip":
        return s.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?:2[0-9A-Fa-f]{3}|3[0-9A-Fa-f]{3}|[fF][cdCD][0-9A-Fa-f]{2}|[fF][eE]80):")
    if kind == "secret":  # prefixes of keys; digests look the same, secret or not
        hexes = "|".join(f"{c}{{{n}}}" for c in ("[0-9a-f]", "[0-9A-F]") for n in (32, 40, 64))
        return F.when(s.rlike(r"^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-|eyJ)"), F.lit(True)).when(~s.rlike(rf"^(?:{hexes})$"), F.lit(False))
    if kind == "card":
        return _digits(s).rlike("^(?:4|5[1-5]|2[2-7]|3[0-9]|6)")
    return s.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[58][0-9]|9[679][0-9])|^\(?[2-9][0-9]{2}\)?[\x20.-]")


def _structure(kind: str, s: Column) -> Column:
    if kind == "email":
        return s.rlike(r"^.{1,64}(?:@|\[at\]|\(at\)|\x20)") & s.rlike("[A-Za-z]")
    if kind == "ip":
        return _parts_fit(s) | F.contains(s, F.lit(":"))
    if kind == "secret":  # letters and digits well mixed, as in random strings
        return (F.length(_digits(s)) >= 4) & (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 4)
    return _passes(kind, s)


def _votes(kind: str, text: Column, m: Column, strict: Column) -> Column:
    before = F.lower(F.substr(text, F.greatest(m["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(CONTEXT)).cast("int")))
    around = F.concat(F.substr(before, F.length(before), F.lit(1)), F.lit("\n"), F.substr(text, (m["end"] + 1).cast("int"), F.lit(1)))
    yes = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    if kind == "secret":  # no base pattern: what an assignment gives
        strict = before.rlike("""[=:]\\s*["']?$""")
    return F.array(
        yes(strict), F.coalesce(_gazetteer(kind, m["s"]).cast("int"), F.lit(-1)), F.when(before.rlike(CUES[kind]), F.lit(1)).when(before.rlike(AGAINST[kind]), F.lit(0)).otherwise(F.lit(-1)),
        yes(_structure(kind, m["s"])), yes(~around.rlike(r"^[\p{L}\p{N}_]|[\p{L}\p{N}_]$")),
    )


def _told(k: int, text: Column, strict: bool):
    """A function from a match to a candidate."""

    def of(m: Column) -> Column:
        base = _passes(KINDS[k], m["s"]) if strict else F.lit(False)
        return F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), _votes(KINDS[k], text, m, base).alias("votes"), F.when(F.length(m["s"]) > 14, 1).otherwise(0).alias("long"),
        )

    return of


def candidates(text: Column) -> Column:
    """All candidates of a text: (kind number, start, end, base, votes, long)."""
    full = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        parts = []
        for k, kind in enumerate(KINDS):
            for strict in (True, False) if kind in BASE else (False,):
                found = _matches(t, (BASE if strict else LOOSE)[kind], HINT[kind, strict])

                parts.append(F.transform(found, _told(k, t, strict)))
        return F.concat(*parts)

    return F.when(full.rlike("[0-9@]|[\\[(]at[\\])]|:"), let(full, of)).otherwise(F.array().cast(NO_SPANS))


# -- weak supervision -------------------------------------------------------------------------------------------------


def estimate(patterns: list[tuple[int, tuple[int, ...], int, int]]) -> list[float]:
    """The probability that the candidates of each pattern (kind, votes, long, count) are personal data, by expectation-maximisation over labelers whose errors are independent, with rates of their own for each kind. It starts from the share of yes votes."""
    share = [sum(v == 1 for v in votes) / max(1, sum(v >= 0 for v in votes)) for _, votes, _, _ in patterns]
    p = [min(0.95, max(0.05, x)) for x in share]
    for _ in range(ROUNDS):
        prior, rate = {}, {}
        for kind in range(len(KINDS)):
            own = [(q, votes, n) for q, (k, votes, _, n) in zip(p, patterns, strict=True) if k == kind]
            prior[kind] = (sum(q * n for q, _, n in own) + 1) / (sum(n for _, _, n in own) + 2)
            for j in range(LABELERS):
                for truth in (0, 1):
                    weight = [(q if truth else 1 - q) * n for q, _, n in own]
                    said = sum(x for x, (_, votes, _) in zip(weight, own, strict=True) if votes[j] >= 0)
                    yes = sum(x for x, (_, votes, _) in zip(weight, own, strict=True) if votes[j] == 1)
                    # five imagined votes hold a labeler's rates near 0.8 and 0.2 until it has spoken often
                    rate[kind, j, truth] = (yes + (4 if truth else 1)) / (said + 5)
        p = []
        for kind, votes, _, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                if v >= 0:
                    a, b = rate[kind, j, 1], rate[kind, j, 0]
                    odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p


def features(kind: int, votes: tuple[int, ...], long: int) -> list[float]:
    """One for the kind, a yes and a no for each labeler, and the length."""
    return [float(kind == k) for k in range(len(KINDS))] + [float(v == s) for v in votes for s in (1, 0)] + [float(long)]


def train(patterns: list[tuple[int, tuple[int, ...], int, int]], p: list[float]) -> list[float]:
    """Weights of the logistic classifier: gradient steps on the log loss against p, each pattern weighing as the log of its count, with a small penalty."""
    rows = [(features(k, votes, long), q, 1 + math.log(n)) for (k, votes, long, n), q in zip(patterns, p, strict=True)]
    w = [0.0] * (len(KINDS) + 2 * LABELERS + 1)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(600):
        g = [1e-3 * x for x in w]
        for x, q, n in rows:
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - q
            for i, v in enumerate(x):
                if v:
                    g[i] += n * e * v / total
        w = [a - 1.5 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(found: DataFrame) -> list[float]:
    """Weights from a table with a column c of candidates()."""
    rows = found.select(F.explode("c").alias("x")).groupBy("x.kind", "x.votes", "x.long").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], tuple(r["votes"]), r["long"], r["n"]) for r in rows)
    return train(patterns, estimate(patterns))


def _score(x: Column, w: list[float]) -> Column:
    total = F.element_at(F.lit(w[: len(KINDS)]), x["kind"] + 1) + x["long"] * w[-1]
    for j in range(LABELERS):
        v = F.element_at(x["votes"], j + 1)
        at = len(KINDS) + 2 * j
        total = total + F.when(v == 1, F.lit(w[at])).when(v == 0, F.lit(w[at + 1])).otherwise(F.lit(0.0))
    return total


def chosen(c: Column, w: list[float]) -> Column:
    """Base spans and added ones, as (kind, start, end, base), by kind and start. Added spans are taken by start, then kind; one that overlaps the last one taken goes."""
    least = math.log(SURE / (1 - SURE))

    def of(all_: Column) -> Column:
        base = F.filter(all_, lambda x: x["base"])
        free = F.filter(all_, lambda x: ~x["base"] & (_score(x, w) >= least) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        slim = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
        ordered = F.sort_array(F.transform(slim(free), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x.alias("x"))))
        none = F.slice(slim(all_), 1, 0)
        # where two or more are free a fold compares each with the last one taken
        taken = F.aggregate(ordered, none, lambda got, y: F.when((F.size(got) > 0) & (F.element_at(got, -1)["end"] > y["start"]), got).otherwise(F.concat(got, F.array(y["x"]))))
        return F.sort_array(F.concat(slim(base), F.when(F.size(free) > 1, taken).otherwise(slim(free))))

    return let(c, of)


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row of df its spans as (kind number, start, end, base)."""
    found = staged(df.select("doc_id", candidates(F.col(text_col)).alias("c")), "pii-candidates")
    return found.select("doc_id", chosen(F.col("c"), fit(found)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind's name in capitals and brackets. Candidates are staged without texts to fit the classifier, and found again beside the texts."""
    slim = staged(df.select(candidates(F.col(text_col)).alias("c")), "pii-fit")
    spans = chosen(candidates(F.col(text_col)), fit(slim))
    names = F.lit([f"[{k.upper()}]" for k in KINDS])

    def masked(all_: Column) -> Column:
        order = F.sort_array(F.transform(all_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

        def step(s: Column, x: Column) -> Column:
            more = F.concat(s["out"], F.substr(F.col("__t"), s["at"] + 1, (x["start"] - s["at"]).cast("int")), F.element_at(names, x["kind"] + 1))
            inside = x["start"] < s["at"]  # overlaps what is masked already
            return F.struct(F.greatest(s["at"], x["end"].cast("int")).alias("at"), F.when(inside, s["out"]).otherwise(more).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(order, first, step, lambda s: F.concat(s["out"], F.substr(F.col("__t"), s["at"] + 1, F.length(F.col("__t")))))

    columns = df.columns
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(text_col).alias("__t"), spans.alias("__s"))
    text = F.when(F.size("__s") > 0, masked(F.col("__s"))).otherwise(F.col("__t"))
    out = rows.select("__row", text.alias("__new"))
    length = F.length("__new").cast(df.schema["n_chars"].dataType) if "n_chars" in columns else None
    fresh = {text_col: F.col("__new"), "n_chars": F.coalesce(length, F.col("__row")["n_chars"]) if length is not None else None}
    return out.select(*(fresh[c].alias(c) if fresh.get(c) is not None else F.col("__row").getField(c).alias(c) for c in columns))
