"""Reading short texts by their tokens: numbers, sums of money, dates, ratios and what stands near key words."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Iterator

NUMBER_WORDS = {w: k for k, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"))}
MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}
WEEKDAYS = {d.lower() for d in calendar.day_name}
CURRENCIES = {"rs", "inr", "₹"}
ORDINALS = {"st", "nd", "rd", "th"}
LEXEME = re.compile(r"[0-9]+|[^\W\d_]+|\S")


class Scanner:
    """The tokens of a text: runs of digits, runs of letters, other signs alone; in lower case, with their places."""

    def __init__(self, text: str):
        found = [(m[0].lower(), m.start(), m.end()) for m in LEXEME.finditer(text)]
        self.tokens = [t for t, _, _ in found] + [""]
        self.start = [s for _, s, _ in found] + [len(text)]
        self.end = [e for _, _, e in found] + [len(text)]

    def __len__(self) -> int:
        return len(self.tokens) - 1

    def says(self, k: int, *words: str) -> bool:
        return tuple(self.tokens[k : k + len(words)]) == words

    def glued(self, k: int) -> bool:
        """Whether token k follows the one before without a blank."""
        return k > 0 and self.start[k] == self.end[k - 1]

    def number(self, k: int) -> int | None:
        """A whole number of up to nine digits, or in words up to twelve."""
        t = self.tokens[k]
        return int(t) if t.isdecimal() and len(t) < 10 else NUMBER_WORDS.get(t)

    def amount(self, k: int) -> tuple[float, int] | None:
        """A number that may have decimals, and the token behind it."""
        if not self.tokens[k].isdecimal():
            return None
        if self.tokens[k + 1 : k + 2] == ["."] and self.tokens[k + 2 : k + 3] and self.tokens[k + 2].isdecimal() and self.glued(k + 1) and self.glued(k + 2):
            return float(f"{self.tokens[k]}.{self.tokens[k + 2]}"), k + 3
        return float(self.tokens[k]), k + 1

    def money(self, k: int) -> tuple[float, int] | None:
        if self.tokens[k] not in CURRENCIES:
            return None
        return self.amount(k + 2 if self.tokens[k + 1] == "." else k + 1)

    def ratio(self, k: int) -> tuple[int, int, int] | None:
        """a : b in digits, and the token behind it."""
        a, b = self.tokens[k], self.tokens[k + 2 : k + 3]
        if a.isdecimal() and self.tokens[k + 1] == ":" and b and b[0].isdecimal():
            return int(a), int(b[0]), k + 3
        return None

    def date(self, k: int) -> tuple[dt.date | None, int] | None:
        """A date that begins at token k, day before month where both are numbers, and the token behind it; no day of the calendar is None."""
        return self._numeric(k) or self._named(k)

    def _numeric(self, k: int) -> tuple[dt.date | None, int] | None:
        day, one, month, two, year = (self.tokens[k : k + 5] + [""] * 5)[:5]
        if one in ("-", "/", ".") and two in ("-", "/", ".") and day.isdecimal() and month.isdecimal() and year.isdecimal() and len(day) < 3 and len(month) < 3 and len(year) == 4 and all(map(self.glued, range(k + 1, k + 5))):
            return _date(int(year), int(month), int(day)), k + 5
        return None

    def _day(self, k: int) -> tuple[int, int] | None:
        if not self.tokens[k].isdecimal() or len(self.tokens[k]) > 2:
            return None
        return int(self.tokens[k]), k + 2 if self.tokens[k + 1] in ORDINALS and self.glued(k + 1) else k + 1

    def _named(self, k: int) -> tuple[dt.date | None, int] | None:
        month, at = MONTHS.get(self.tokens[k]), k + 1
        if month:
            at = self._past(at, ".")
            day = self._day(at)
        elif day := self._day(k):
            at = self._past(self._past(day[1], "of"), "-")
            month = MONTHS.get(self.tokens[at])
            day = month and (day[0], at + 1)
        if not day or not month:
            return None
        at = self._past(self._past(self._past(day[1], "."), ","), "-")
        year = self.tokens[at]
        return (_date(int(year), month, day[0]), at + 1) if year.isdecimal() and len(year) == 4 else None

    def _past(self, k: int, token: str) -> int:
        return k + 1 if self.tokens[k] == token else k

    def near(self, k: int, limit: int, stops: str) -> Iterator[int]:
        """The tokens from k on that begin within `limit` characters of the end of the token before k, up to a stop. A weekday and its
        comma take no room."""
        begin, free = self.end[k - 1], 0
        for at in range(k, len(self)):
            if self.start[at] - begin - free > limit + 1:
                return
            yield at
            if self.tokens[at] in stops:
                return
            if self.tokens[at] in WEEKDAYS:
                free += self.end[self._past(at + 1, ",") - 1] - self.start[at] + 1

    def date_near(self, k: int, limit: int, stops: str = ".|") -> tuple[dt.date | None, int] | None:
        for at in self.near(k, limit, stops):
            if (found := self.date(at)) and not (at and self.tokens[at - 1].isdecimal() and self.glued(at)):
                return found
        return None


def _date(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None
