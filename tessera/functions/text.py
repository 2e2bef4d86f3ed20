"""Text functions of the news and filing queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that name a campaign and not a page (fixed values).
TRACKING = "^(utm_.*|fbclid|gclid|ref|src)="


def normal_title(title: Column) -> Column:
    """Lower case, other characters than letters, digits and % to single blanks."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9%]+", " "))


def distinguishing_tokens(title: Column) -> Column:
    """Words with a digit, and weekdays: two titles that differ in them tell of different things."""
    days = "^(mon|tues|wednes|thurs|fri|satur|sun)day$"
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_title(title), " "), lambda w: w.rlike("[0-9]") | w.rlike(days))))


def normal_url(url: Column) -> Column:
    """https, lower host without default port, no fragment, closing slash or tracking parameters; the
    other parameters sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.lit("https://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def url_id(url: Column) -> Column:
    return F.substring(F.sha2(normal_url(url), 256), 1, 32)


def without_tags(html: Column) -> Column:
    """Text of a page: tags to blanks, blanks joined, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " ")), F.lit(""))


def without_boilerplate(text: Column, pattern: str) -> Column:
    """Lines that begin with the pattern go."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(f"^(?:{pattern})")), "\n")


def leading_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != ""), 1, n), " ")


def page_outcome(content_type: Column, html: Column, text: Column, paid: str, least: int) -> Column:
    """What a fetched page gives: failed if it is no page, paywalled by a mark in it, retry if its text is short, else ok."""
    return F.when(~F.contains(content_type, F.lit("html")), "failed").when(html.rlike(f"(?i){paid}"), "paywalled").when(F.coalesce(F.length(text), F.lit(0)) < least, "retry").otherwise("ok")


def redacted(text: Column, secrets: str = r"(?i)((?:token|key|secret|password)\s*[=:]\s*)\S+") -> Column:
    return F.regexp_replace(text, secrets, "$1[redacted]")


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def _digits(token: Column, least: int, most: int = 1000) -> Column:
    return F.length(token).between(least, most) & (F.translate(token, "0123456789", "") == "")


def repaired_numbers(line: Column) -> Column:
    """Decimal points that scanning lost: "18187 49" and "11275,87". A long run of digits takes the two digits of the next token, and a comma
    before the last two digits is a point."""
    of = _tokens(line)
    tail = lambda x: _digits(F.ltrim(x, F.lit("(-")), 3)
    two = lambda k: _digits(F.get(of, k), 2, 2)
    # Of three such tokens in a row the first two belong together.
    joins = lambda k: F.coalesce(tail(F.get(of, k)) & two(k + 1), F.lit(False))
    merged = F.filter(F.transform(of, lambda x, k: F.when((k > 0) & joins(k - 1), "").when(joins(k), F.concat(x, F.lit("."), F.get(of, k + 1))).otherwise(x)), lambda x: x != "")

    def pointed(x: Column) -> Column:
        end = F.when(F.endswith(x, F.lit("%")), F.lit("%")).otherwise("")
        bare = F.rtrim(x, F.lit("%"))
        parts = F.split(bare, ",")
        whole = (F.size(parts) == 2) & _digits(F.get(parts, F.lit(1)), 2, 2) & _digits(F.get(parts, F.lit(0)), 1)
        return F.when(whole, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), end)).otherwise(x)

    return F.array_join(F.transform(merged, pointed), " ")


def last_numbers(line: Column) -> Column:
    """The numbers that end a row of a table, in order; those in parentheses are negative, notes in parentheses are none. A fold over the tokens:
    numbers are kept until another word begins anew."""
    plain = lambda x: F.translate(x, "(),%", "").try_cast("double")
    value = lambda x: F.when(F.left(x, F.lit(1)).isin(*"(-0123456789") & ~F.startswith(x, F.lit("-(")), F.when(F.startswith(x, F.lit("(")), -plain(x)).otherwise(plain(x)))
    opens = lambda x: F.lower(x).startswith("(note") | F.lower(x).startswith("(refer")
    step = lambda a, x: F.when(a["note"] | opens(x), F.struct((~F.contains(x, F.lit(")"))).alias("note"), a["n"].alias("n"))).when(value(x).isNotNull(), F.struct(F.lit(False).alias("note"), F.concat(a["n"], F.array(value(x))).alias("n"))).otherwise(F.struct(F.lit(False).alias("note"), F.array().cast("array<double>").alias("n")))
    start = F.struct(F.lit(False).alias("note"), F.array().cast("array<double>").alias("n"))
    # "( 5 )" and "( Note 5 )" are one token each.
    tight = F.regexp_replace(F.regexp_replace(line, r"\(\s+", "("), r"\s+\)", ")")
    return F.aggregate(_tokens(repaired_numbers(tight)), start, step, lambda a: a["n"])
