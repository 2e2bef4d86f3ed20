"""Personal data by weak supervision.

Four kinds have exact patterns, the base. Further spans (secrets, telephone numbers without a
country, social security numbers) are candidates of wide patterns. Labelers vote on each: a strict
pattern, a gazetteer of words that announce such data, the context around the span, and its
character mix. Expectation maximisation over the counts of vote patterns, at most 81, estimates
how reliable each labeler is and how likely each candidate is true; with these as soft labels a naive Bayes
classifier over hashed span features is counted, and it decides.

All of it is DataFrame expressions. Only counts by vote pattern and by feature reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java matches the same spans without retrying inside a
#: run of characters (possessive quantifiers) and without a stack frame for each repetition. A run
#: is entered at its first character, or where the match before it ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Wide patterns of the candidates, by kind: their numbers follow those of KINDS.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
STRICT = {"secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{20,})$", "local_phone": r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"}
GAZETTEER = {"secret": "token|secret|password|passwd|pwd|api|key|auth|credential|bearer", "local_phone": "tel|phone|call|fax|mobil|contact|whatsapp", "ssn": "ssn|social security|tax id"}
#: The end of the text before the span.
CONTEXT = {"secret": r"[=:]\s*[\"']?$", "local_phone": r"(?:[:]|\b(?:at|on|call|number|nummer|tel|phone)\.?)\s*$", "ssn": r"(?:[:#]|\bis|\bnumber)\s*$"}
LABELERS = ("strict", "gazetteer", "context", "mix")
AROUND = 24
BUCKETS = 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _spans(text: str, pattern: str, kind: int, good: Callable[[Column], Column], around: bool = False) -> Column:
    """array<struct<start, kind, end, m>> of the matches m that are good, with `around` also before and after: the last AROUND
    characters between the match and the one before it, and the first ones behind it. What lies between
    the matches gives the positions: runs of the root of their number are summed first, then within each run from its
    beginning, so that a text of n matches costs n times the root of n and not n squared."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    pairs = F.zip_with(gaps, m, lambda g, x: F.struct(F.length(g).alias("g"), x.alias("x"), *[F.right(g, F.lit(AROUND)).alias("b")] * around))
    kind_type = "array<struct<start:int,kind:int,end:int,m:string" + ",before:string,after:string" * around + ">>"
    if around:
        next_ = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.lit(1), F.size(gaps))), lambda g: F.left(g, F.lit(4)))
        pairs = F.zip_with(pairs, next_, lambda p, a: p.withField("a", a))
    width = lambda p: p["g"] + F.coalesce(F.length(p["x"]), F.lit(0))

    def in_run(run: Column, at: Column) -> Column:
        none = F.struct(at.alias("at"), F.array().cast(kind_type).alias("got"))

        def step(a: Column, p: Column) -> Column:
            start, end = a["at"] + p["g"], a["at"] + width(p)
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["x"].alias("m"), *[p["b"].alias("before"), p["a"].alias("after")] * around)
            return F.struct(end.alias("at"), F.when(p["x"].isNotNull() & good(p["x"]), F.concat(a["got"], F.array(one))).otherwise(a["got"]).alias("got"))

        return F.aggregate(run, none, step, lambda a: a["got"])

    def of(pairs: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(pairs), n), lambda i: F.slice(pairs, i, n))
        begin = F.array(F.lit(0)).cast("array<int>")
        upto = F.aggregate(runs, begin, lambda a, run: F.concat(a, F.array(F.element_at(a, -1) + F.aggregate(run, F.lit(0), lambda s, p: s + width(p)))))
        return F.flatten(F.zip_with(runs, F.slice(upto, F.lit(1), F.size(runs)), in_run))

    # The pairs are made once and held in an array of one element.
    made = F.get(F.transform(F.array(pairs), of), F.lit(0))
    return F.when(F.col(text).rlike(pattern), made).otherwise(F.array().cast(kind_type))


def _base(text: str) -> Column:
    return F.concat(
        _spans(text, _EMAIL, 0, lambda m: F.lit(True)),
        _spans(text, _IP, 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        # No need to look at runs that are too short.
        _spans(text, _CARD.replace("++", "{13,}+"), 2, lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))),
        _spans(text, _PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15)),
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidates(text: str) -> Column:
    """array<struct<start, kind, end, votes, features>>"""

    def judge(name: str) -> Callable[[Column], Column]:
        def judged(c: Column) -> Column:
            before, after = c["before"], c["after"]
            turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(c["m"], "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]", ""))
            announced = F.lower(before).rlike(GAZETTEER[name])
            votes = F.array(
                _vote(c["m"].rlike(STRICT[name]), c["m"].rlike(r"^[A-Za-z]+[0-9]{1,4}$|^[0-9]{1,4}[A-Za-z]+$")),
                _vote(announced, ~announced & before.rlike(r"[A-Za-z]{2,}[\s.,]*$")),
                _vote(before.rlike(CONTEXT[name]), before.rlike(r"[A-Za-z0-9][./-]$") | after.rlike(r"^[./-][A-Za-z0-9]")),
                _vote((turns >= 6) if name == "secret" else (turns == 3), (turns < 4) if name == "secret" else (turns > 3)),
            )
            last_word = F.regexp_extract(F.lower(before), r"([\p{L}_]+)\P{L}*$", 1)
            shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(c["m"], 1, 6), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
            features = [F.lit(f"kind:{name}"), F.concat(F.lit("word:"), last_word), F.concat(F.lit("gap:"), F.regexp_extract(before, r"([^\p{L}0-9]*)$", 1)), F.concat(F.lit("shape:"), shape), F.concat(F.lit("size:"), F.least(c["end"] - c["start"], F.lit(48)).cast("string")), F.concat(F.lit("turns:"), F.least(turns, F.lit(12)).cast("string"))]
            return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), votes.alias("votes"), F.array(*[F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") for x in features]).alias("features"))

        return judged

    return F.concat(*[F.transform(_spans(text, pattern, len(KINDS) + k, lambda m: F.lit(True), around=True), judge(name)) for k, (name, pattern) in enumerate(CANDIDATES.items())])


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """The probability that a candidate with these votes is true, by expectation maximisation:
    given the truth, labelers vote (-1, 0 or 1) independently. Starts from the majority."""
    true = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * true[v] for v, n in counts.items()) + 1) / (total + 2)
        table = {}
        for k in range(len(LABELERS)):
            for vote in (-1, 0, 1):
                # A labeler is taken to be rather right than wrong before any count.
                p = sum(n * true[v] for v, n in counts.items() if v[k] == vote) + 1 + vote * 0.5
                q = sum(n * (1 - true[v]) for v, n in counts.items() if v[k] == vote) + 1 - vote * 0.5
                table[k, vote] = p, q
        sums = [[sum(table[k, v][s] for v in (-1, 0, 1)) for s in (0, 1)] for k in range(len(LABELERS))]
        for v in true:
            odds = math.log(share / (1 - share)) + sum(math.log(table[k, x][0] / sums[k][0]) - math.log(table[k, x][1] / sums[k][1]) for k, x in enumerate(v))
            true[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return true


def span_classifier(found: DataFrame) -> tuple[float, list[float]]:
    """Log odds of a candidate before its features, and by feature bucket."""
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    counts = {tuple(r["votes"]): r["n"] for r in each.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return 0.0, [0.0] * BUCKETS
    true = reliabilities(counts)
    soft = F.create_map(*[F.lit(x) for v, p in true.items() for x in (",".join(map(str, v)), p)])[F.concat_ws(",", "votes")]
    sums = each.select(soft.alias("p"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q")).collect()
    yes, no = sum(n * true[v] for v, n in counts.items()), sum(n * (1 - true[v]) for v, n in counts.items())
    weights = [0.0] * BUCKETS
    for r in sums:
        weights[r["f"]] = math.log((r["p"] + 1) / (yes + 2)) - math.log((r["q"] + 1) / (no + 2))
    return math.log((yes + 1) / (no + 1)), weights


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of (start, kind, end), in code points, end exclusive, in the order of
    start and kind; a row for each row of docs (doc_id, text).

    kind numbers KINDS, then CANDIDATES. `more` are the candidates that the classifier takes and that
    overlap no base span. A null or empty text has no spans; rows that repeat are each
    searched; very long texts are searched whole; an empty table gives an empty result. Other columns are ignored."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    # Spans only: the table holds no text.
    found = rows.select("doc_id", F.transform(_base("text"), lambda x: F.struct(x["start"], x["kind"], x["end"])).alias("base"), _candidates("text").alias("candidates"))
    found = materialise(found, "spans")
    prior, weights = span_classifier(found)
    score = lambda c: F.aggregate(c["features"], F.lit(prior), lambda a, f: a + F.element_at(F.lit(weights), f + 1))
    # Base spans by start, in runs of the root of their number with the bounds of each: a candidate looks into those that it meets.
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("base"))).cast("int"))
    cut = lambda base: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(base)), n), lambda i: F.slice(base, i, n))
    bounds = lambda r: F.struct(F.get(r, F.lit(0))["start"].alias("low"), F.array_max(F.transform(r, lambda b: b["end"])).alias("high"), r.alias("spans"))
    runs = F.transform(F.filter(cut(F.sort_array("base")), lambda r: F.size(r) > 0), bounds)
    meets = lambda c, low, high: (low < c["end"]) & (c["start"] < high)
    # The runs are made once for a text and held in an array of one element: by name they would be made for each candidate.
    free = F.get(F.transform(F.array(runs), lambda runs: F.filter("candidates", lambda c: ~F.exists(runs, lambda r: meets(c, r["low"], r["high"]) & F.exists(r["spans"], lambda b: meets(c, b["start"], b["end"]))))), F.lit(0))
    more = F.transform(F.filter(free, lambda c: score(c) > 0), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return found.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(more).alias("more"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *CANDIDATES)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "more"))).alias("spans"))
