"""Which of the watched companies a text is about: names as whole words, with rules on case, context and dates.

A registry has a row for each company: symbol; aliases, which always count; ambiguous names, which are common words too and
need a word of finance in their sentence; conditional names, which from a date on need words of their own in their sentence; and
phrases in which none of them count. An automaton over the tokens of a text has the terms of the whole registry, so that each text is
read once; an Arrow function gives the hits, a few numbers for each, and what they are worth are column expressions."""

from __future__ import annotations

import datetime as dt
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of finance, of market reports, abbreviations that end no sentence, and moves of a price.
FINANCE = ("share", "stock", "result", "profit", "loss", "target", "earnings", "revenue", "dividend", "quarter", "quarterly", "price", "m-cap", "market cap", "valuation", "brokerage", "rating", "guidance", "buyback", "stake", "investor", "margin", "loan", "deposit", "net interest income", "listing", "Sensex", "Nifty", "NSE", "BSE", "IPO", "NII", "NPA", "RBI", "CEO", "Q1", "Q2", "Q3", "Q4")
MARKET = ("Sensex", "Nifty", "stock market today", "closing bell", "opening bell", "market wrap", "top gainers", "top losers", "market highlights")
ABBREVIATIONS = {"ltd", "rs", "co", "inc", "corp", "mr", "mrs", "ms", "dr", "no", "vs", "st"}
MOVES = r"\s+(?:shares?\s+|stocks?\s+)?(?:jump(?:s|ed)?|fall(?:s|ing)?|fell|rise(?:s|n)?|rose|rising|gain(?:s|ed)?|slip(?:s|ped)?|surge(?:s|d)?|tank(?:s|ed)?|rall(?:y|ies|ied)|drop(?:s|ped)?|climb(?:s|ed)?)\b"
LIST_TAIL = r"(?:,|&|\band)\s*$"
SENTENCE_END = r"\n+|(?<=[.!?])\s+(?=[A-Z0-9\"'(‘“])"
LONG_BODY = 1500
THRESHOLD = 0.5
#: Characters of texts whose hits leave the function together.
TOGETHER = 1_000_000
PLACES = ("title", "summary", "body")
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")


@dataclass(frozen=True)
class Conditional:
    names: tuple[str, ...]
    context: tuple[str, ...]
    since: dt.date | None = None


@dataclass(frozen=True)
class Company:
    symbol: str
    name: str = ""
    aliases: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    conditional: tuple[Conditional, ...] = ()
    excludes: tuple[str, ...] = ()
    search: tuple[str, ...] = ()


def _words(term: str) -> list[str]:
    """The term's tokens: runs of word characters, one blank for white space, other characters alone."""
    return [" " if t.isspace() else t for t in TOKEN.findall(term.strip())]


def spellings(term: str, any_case: bool = False) -> set[str] | None:
    """How the term may be written; None for any case. Terms in capitals stand as they are, terms in lower case (and all with any_case)
    in any case, others as they are or all in capitals."""
    term = "".join(_words(term))
    if term.isupper():
        return {term}
    return None if any_case or term[0].islower() else {term, term.upper()}


class TermAutomaton:
    """All terms of a registry in one automaton over the tokens of a text, so that a text is read once, however many terms there are."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, set[str] | None, object]]] = [[]]
        self.back: list[int] = []

    def add(self, term: str, of: object, any_case: bool = False, plural: bool = False) -> None:
        """A term, or its plurals too, whose occurrences are reported with `of`."""
        allowed = spellings(term, any_case)
        for ending in ("", "s", "es") if plural else ("",):
            words = _words(term + ending)
            known = allowed and {x + (ending.upper() if x.isupper() and not term.isupper() else ending) for x in allowed}
            state = 0
            for w in words:
                state = self.next[state].setdefault(w.lower(), len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.ends.append([])
            self.ends[state].append((len(words), known, of))

    def link(self) -> None:
        """Where to go on, for each state, when a token does not continue it."""
        self.back = [0] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:
            for word, after in self.next[state].items():
                at = self.back[state]
                while at and word not in self.next[at]:
                    at = self.back[at]
                self.back[after] = self.next[at].get(word, 0)
                queue.append(after)
            self.ends[state] = self.ends[state] + self.ends[self.back[state]]

    def find(self, text: str) -> Iterator[tuple[int, int, object]]:
        """(start, end, of) of every occurrence, by its end."""
        tokens = TOKEN.findall(text)
        # All at once where that gives the same tokens.
        low = [t.lower() for t in tokens] if "\0" in text else "\0".join(tokens).lower().split("\0")
        begins = list(accumulate(map(len, tokens), initial=0))
        goes, back, ends, state = self.next, self.back, self.ends, 0
        root = goes[0]
        for k, word in enumerate(low):
            if not state:
                # Terms begin with no blank, so that most tokens end here.
                if word not in root:
                    continue
                state = root[word]
            else:
                if word not in goes[state]:
                    if word.isspace():
                        word = " "
                    while state and word not in goes[state]:
                        state = back[state]
                state = goes[state].get(word, 0)
            for n, allowed, of in ends[state]:
                first = k - n + 1
                if allowed is not None and "".join(" " if t.isspace() else t for t in tokens[first : k + 1]) not in allowed:
                    continue
                start, end = begins[first], begins[k + 1]
                # Terms that begin or end with another sign than a word's stand alone too.
                if (start and _is_word(text[start - 1])) or (end < len(text) and _is_word(text[end])):
                    continue
                yield start, end, of


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class Sentences:
    """The sentences of a text, by position."""

    ending = re.compile(SENTENCE_END)

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, [0], []
        for m in self.ending.finditer(text):
            if "\n" in m[0] or self._word_before(m.start()).lower() not in ABBREVIATIONS:
                self.end.append(m.start())
                self.begin.append(m.end())
        self.end.append(len(text))

    def _word_before(self, place: int) -> str:
        """The last word before place, without the marks that end it: no more of the text is looked at."""
        text, end = self.text, place
        while end and text[end - 1] in ".!?":
            end -= 1
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and not text[start - 1].isspace():
            start -= 1
        return text[start:end]

    def number(self, place: int) -> int:
        """A place between two sentences belongs to the first one."""
        return bisect_right(self.begin, place) - 1

    def at(self, place: int) -> str:
        k = self.number(place)
        return self.text[self.begin[k] : self.end[k]]


#: What a term is in the registry for.
_NAME, _EXCLUDED, _CONTEXT, _MARKET = range(4)


class Registry:
    """The names of all companies in one automaton, with the words that their contexts and market reports are known by."""

    def __init__(self, companies: list[Company], finance: tuple[str, ...] = FINANCE, market: tuple[str, ...] = MARKET):
        self.companies, self.terms, contexts = companies, TermAutomaton(), {}

        def context(words: tuple[str, ...]) -> int:
            if words not in contexts:
                contexts[words] = len(contexts)
                for w in words:
                    self.terms.add(w, (_CONTEXT, contexts[words]), plural=True)
            return contexts[words]

        for w in market:
            self.terms.add(w, (_MARKET,))
        for c, company in enumerate(companies):
            for x in company.excludes:
                self.terms.add(x, (_EXCLUDED, c), any_case=True)
            for n in dict.fromkeys((*company.aliases, company.symbol)):
                self.terms.add(n, (_NAME, c, 0, n, None, None), any_case=True)
            for rule in company.conditional:
                for n in rule.names:
                    self.terms.add(n, (_NAME, c, 1, n, context(rule.context), rule.since), any_case=True)
            for n in company.ambiguous:
                self.terms.add(n, (_NAME, c, 2, n, context(finance), None))
        self.terms.link()

    def hits(self, text: str | None, day: dt.date) -> tuple[list[tuple[int, str, int, bool, int, int]], int]:
        """(company, name, kind, whether it is strong, start, end) of each name that counts; and where a word of market reports stands, or -1."""
        names, excluded, contexts, report = defaultdict(list), defaultdict(list), defaultdict(list), -1
        for start, end, of in self.terms.find(text or ""):
            if of[0] == _NAME:
                names[of[1]].append((start, -len(of[3]), of[2], end, of))
            elif of[0] == _CONTEXT:
                contexts[of[1]].append((start, end))
            elif of[0] == _EXCLUDED:
                excluded[of[1]].append((start, -end))
            elif report < 0 or start < report:
                report = start
        out, whole = [], None
        for c in sorted(names):
            gone = _apart(excluded[c])
            sentences = None
            upto = 0
            # Of names that begin at one place the longest counts, and of equal ones the stronger.
            for start, _, kind, end, (_, _, _, name, context, since) in sorted(names[c], key=lambda n: n[:3]):
                if start < upto or _touches(gone, start, end):
                    continue
                upto = end
                early = kind == 1 and since is not None and day < since
                if kind and not early:
                    if gone:
                        sentences = sentences or Sentences(_blanked(text, gone))
                    else:
                        sentences = whole = whole or Sentences(text)
                    k = sentences.number(start)
                    if not _within(contexts[context], sentences.begin[k], sentences.end[k], gone):
                        continue
                out.append((c, name, kind, not kind or early, start, end))
        return out, report


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, -end), first and longest first, without those that begin within another one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if not out or start >= out[-1][1]:
            out.append((start, -end))
    return out


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect_right(spans, (start, math.inf))
    return (k > 0 and spans[k - 1][1] > start) or (k < len(spans) and spans[k][0] < end)


def _within(found: list[tuple[int, int]], begin: int, end: int, gone: list[tuple[int, int]]) -> bool:
    """Whether one of found lies from begin to end and touches nothing of gone. They are in the order of their ends."""
    for k in range(bisect_right(found, begin, key=lambda s: s[1]), len(found)):
        if found[k][1] > end:
            return False
        if found[k][0] >= begin and not _touches(gone, *found[k]):
            return True
    return False


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in spans:
        parts += [text[at:start], " " * (end - start)]
        at = end
    return "".join([*parts, text[at:]])


HITS = "struct<report:int,hits:array<struct<symbol:string,place:int,name:string,kind:int,strong:boolean,start:int,moves:boolean,sentence:int>>,sentences:array<string>>"


def hits(companies: list[Company], finance: tuple[str, ...] = FINANCE, market: tuple[str, ...] = MARKET) -> object:
    """A function of (title, summary, body, day) that gives all hits of all companies, the sentences that have one (each once; a hit
    has its place among them), and where a title names a market report."""
    moves, tail = re.compile(MOVES, re.I), re.compile(LIST_TAIL, re.I)

    @F.pandas_udf(HITS)
    def found(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        registry = Registry(companies, finance, market)
        for batch in parts:
            out, chars = [], 0
            for *texts, day in zip(*batch):
                row, told, reports = [], {}, -1
                for place, text in enumerate(texts):
                    of, report = registry.hits(text, day)
                    if place == 0:
                        reports = report
                    sentences, known = Sentences(text) if of else None, {}
                    for c, name, kind, strong, start, end in of:
                        k = sentences.number(start)
                        if k not in known:
                            known[k] = told.setdefault(sentences.at(start).strip(), len(told))
                        moved = place == 0 and moves.match(text, end) is not None and tail.search(text[:start]) is None
                        row.append((companies[c].symbol, place, name, kind, strong, start, moved, known[k]))
                    chars += len(text or "")
                out.append((reports, row, list(told)))
                # A batch of texts has far more hits than fit into memory as easily as the texts do: they go in parts.
                if chars >= TOGETHER:
                    yield pd.DataFrame(out, columns=["report", "hits", "sentences"])
                    out, chars = [], 0
            if out:
                yield pd.DataFrame(out, columns=["report", "hits", "sentences"])

    # Else a filter on the hits is pushed below, and every text is read a second time for it.
    return found.asNondeterministic()


def mentions(rows: DataFrame, companies: list[Company], day: str = "day", finance: tuple[str, ...] = FINANCE, market: tuple[str, ...] = MARKET) -> DataFrame:
    """The columns of rows (title, summary, body, day and others) for each company that is named in one, with symbol, matched_alias,
    location, mention_count, confidence and sentences (the distinct ones that name it, in order).

    The first place with a hit says how sure it is: title, summary, then body. In the title of a market report
    the company counts half unless it alone is named before the report's word, or is said to move itself."""
    of = rows.withColumn("_found", hits(companies, finance, market)(F.col("title"), F.col("summary"), F.col("body"), F.col(day))).where(F.size("_found.hits") > 0)
    of = of.withColumn("_hits", F.col("_found.hits"))
    titled = F.array_distinct(F.transform(F.filter("_hits", lambda h: h["place"] == 0), lambda h: h["symbol"]))
    of = of.withColumn("_titled", F.size(titled)).withColumn("symbol", F.explode(F.array_distinct(F.transform("_hits", lambda h: h["symbol"]))))
    of = of.withColumn("_own", F.filter("_hits", lambda h: h["symbol"] == F.col("symbol"))).withColumn("_place", F.array_min(F.transform("_own", lambda h: h["place"])))
    here = F.filter("_own", lambda h: h["place"] == F.col("_place"))
    of = of.withColumn("_here", here).withColumn("mention_count", F.size("_own").cast("long"))
    strong, moves = F.exists("_here", lambda h: h["strong"]), F.exists("_here", lambda h: h["moves"])
    report = F.col("_found.report")
    leads = (F.col("_titled") == 1) & (F.get("_here", F.lit(0))["start"] < report)
    wrapped = (F.col("_place") == 0) & (report >= 0) & ~leads & ~moves
    sure = worth(F.col("_place"), strong, F.col("mention_count"), F.length(F.coalesce("body", F.lit(""))))
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.col("_place") + 1)
    own = F.array_distinct(F.transform("_own", lambda h: h["sentence"]))
    sentences = F.filter(F.transform(own, lambda k: F.get("_found.sentences", k)), lambda s: s != "")
    return of.select(*rows.columns, "symbol", F.get("_here", F.lit(0))["name"].alias("matched_alias"), place.alias("location"), "mention_count", F.bround(F.when(wrapped, sure * 0.5).otherwise(sure), 3).alias("confidence"), sentences.alias("sentences"), F.exists("_own", lambda h: h["kind"] == 1).alias("by_condition"))


def worth(place: Column, strong: Column, count: Column, body_chars: Column) -> Column:
    """How sure a mention is, by its first place, whether a strong name stands there, and how often it is named."""
    body = F.when(count >= 3, 0.7).when((count == 2) | (body_chars < LONG_BODY), 0.55).otherwise(0.3)
    return F.when(place == 0, F.when(strong, 0.95).otherwise(0.8)).when(place == 1, F.when(strong, 0.75).otherwise(0.65)).otherwise(F.when(strong, body).otherwise(body - 0.1))


def scored_text(title: Column, sentences: Column, limit: int) -> Column:
    """What a scorer reads of an article: its title and up to `limit` sentences that name the company."""
    title = F.trim(F.coalesce(title, F.lit("")))
    return F.array_join(F.concat(F.array(title), F.slice(F.filter(sentences, lambda s: s != title), F.lit(1), F.lit(limit))), " ")


def quality(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall of pairs; 1 where there is nothing to find or nothing was found."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(expected.select(*keys).distinct().withColumn("e", F.lit(1)), keys, "full")
    hit = F.sum(F.coalesce(F.col("p") * F.col("e"), F.lit(0)))
    return both.agg(F.coalesce(F.try_divide(hit, F.sum("p")), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(hit, F.sum("e")), F.lit(1.0)).alias("recall"))


def names_any(title: Column, terms: tuple[str, ...]) -> Column:
    """Whether a title has one of the terms as whole words, in any case."""
    words = "|".join(r"\s+".join(map(re.escape, t.split())) for t in sorted(terms, key=len, reverse=True))
    return title.rlike(rf"(?iU)(?<!\w)(?:{words})(?!\w)")


