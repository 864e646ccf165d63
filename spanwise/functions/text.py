"""Text expressions; what the JVM lacks runs as an Arrow-batched function."""

from __future__ import annotations

import difflib
import html.parser
import itertools
import json
import re
import unicodedata
import urllib.parse
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_key(text: Column) -> Column:
    """Lower case without outer or repeated white space: the key that equal labels share."""
    return F.lower(collapse(text))


_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _cased(text: Column) -> Column:
    """Case folded: through capitals, so that one letter folds to several where it should.

    The dotless i is its own fold, and a capital sigma is never a final one; a change of letters
    between two changes of case also keeps the planner from taking the first for needless.
    """
    capitals = F.upper(F.translate(F.lower(text), "ı", "\ue000"))
    return F.translate(F.lower(F.translate(capitals, "\ue000", "\ue001")), "ς\ue001", "σı")


def compact(text: Column) -> Column:
    """Case folded, without white space."""
    return _cased(F.regexp_replace(text, _BLANK, ""))


def fold(s: str) -> str:
    """Compatibility form, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", s).casefold().split())


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form, case folded, white space collapsed."""
    return text.map(lambda s: None if s is None else fold(s))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two texts, without regard to case."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def squeezed(s: str) -> str:
    """Case folded, without white space."""
    return "".join(s.split()).casefold()


#: Up to so many characters blocks are sought as parts of a text, which takes longer than the matcher on long ones.
SHORT = 32
#: So few windows are all matched, which takes less than counting their letters.
FEW = 6


def matched(a: str, b: str) -> int:
    """Characters in matching blocks of two short texts, as the matcher of difflib chooses them: the longest, of these the first in a, then in b, and so on at both sides of it."""
    found, open_ = 0, [(a, b)]
    while open_:
        a, b = open_.pop()
        n, i, j = min(len(a), len(b)), 0, -1
        while n and (j := b.find(a[i : i + n])) < 0:
            i += 1
            if i + n > len(a):
                n, i = n - 1, 0
        if n:
            found += n
            if i and j:
                open_.append((a[:i], b[:j]))
            if i + n < len(a) and j + n < len(b):
                open_.append((a[i + n :], b[j + n :]))
    return found


def window_ratio(one: str, other: str) -> float:
    """Best match of the shorter text with windows of its length in the longer, white space and case aside."""
    return best_of_windows(squeezed(one), squeezed(other))


def best_of_windows(one: str, other: str) -> float:
    """Best match of the shorter text with windows of its length in the longer.

    Matching depends on the order of its two sides: the shorter text is always the first.  A
    window is matched only if the letters it shares could beat the best so far.
    """
    short, long = sorted((one, other), key=len)
    size = len(short)
    if not size:
        return 0.0
    if size < 200 and short in long:  # from 200 characters on the matcher leaves out common ones
        return 1.0
    if size <= SHORT and len(long) - size < FEW:
        return max([matched(short, long[at : at + size]) for at in range(len(long) - size + 1)]) / size
    missing = Counter(short)  # letters of the short text less those of the window
    missing.subtract(long[:size])
    shared = size - sum(n for n in missing.values() if n > 0)
    matcher, best = None if size <= SHORT else difflib.SequenceMatcher(None, short), 0.0
    for at in range(len(long) - size + 1):
        if at:
            gone, come = long[at - 1], long[at + size - 1]
            missing[gone] += 1
            shared -= missing[gone] > 0
            shared += missing[come] > 0
            missing[come] -= 1
        if shared > best * size:
            if matcher is None:
                best = max(best, matched(short, long[at : at + size]) / size)
                continue
            matcher.set_seq2(long[at : at + size])
            best = max(best, matcher.ratio())
    return best


@F.pandas_udf(DoubleType())
def best_window(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else window_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def word_prefix(read: Column, full: Column, fewest: int = 2) -> Column:
    """Whether read is some first words of full, case and spacing aside, and leaves at least so many characters out."""
    short, words = compact(read), F.split(F.trim(_cased(F.regexp_replace(full, _BLANK, " "))), " ")
    ends = F.aggregate(
        F.transform(words, F.length),
        F.struct(F.lit(0).alias("at"), F.length(short).alias("size"), F.lit(False).alias("met")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), s["size"].alias("size"), (s["met"] | (s["at"] + n == s["size"])).alias("met")),
        lambda s: s["met"] & (s["size"] > 0) & (s["at"] - s["size"] >= fewest),
    )
    return ends & F.startswith(F.array_join(words, ""), short)


def pages(rows: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """Every page of size characters of each text: start, slice, and where the next one starts (null for the last)."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = rows.filter(F.col(text).isNotNull()).select(ident, text, F.explode(starts).alias("start"))
    more = F.when(F.length(text) > F.col("start") + size, F.col("start") + size)
    return cut.select(ident, "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("slice"), more.alias("next_start"))


def scrub_paths(text: Column) -> Column:
    """Absolute and home paths to their last part; web addresses and dates stay."""
    return F.regexp_replace(text, r"(^|[\s\"'(=])(?:~|/[^\s/\"'()]+)(?:/[^\s/\"'()]+)*/([^\s/\"'()]+)", "$1$2")


def redacted(pattern: str) -> Callable[[Column | str], Column]:
    """A column function: JSON texts without the keys that match, ignoring case; what is no JSON becomes null."""
    private = re.compile(pattern, re.IGNORECASE)

    def shown(pairs: list[tuple[str, object]]) -> dict[str, object]:
        """An object as it is read, from the innermost out, without private keys."""
        return {k: v for k, v in pairs if not private.search(k)}

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text, object_pairs_hook=shown), ensure_ascii=False)
        except ValueError:
            return None

    return F.pandas_udf(lambda texts: texts.map(one), StringType())


# Elements whose content is not shown, and elements that begin and end lines.
UNSEEN = frozenset("script style noscript svg template head title".split())
LINES = frozenset("p div br li tr section article header footer pre blockquote table ul ol h1 h2 h3 h4 h5 h6".split())


class _Events(html.parser.HTMLParser):
    """The page as a flat list of (kind, value): begin, end and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.events.append(("begin", tag, dict(attrs).get("href") or ""))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, ""))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, ""))


def page_text(page: str | None, base: str = "") -> str:
    """Readable text of a page: headings marked, web links kept with their text, unseen parts left out, at most one empty line in a row.

    Links are found first, each with the place of its end, then everything is written in one pass.
    """
    parser = _Events()
    parser.feed(page or "")
    parser.close()
    opened, target, begins = [], {}, {}
    for i, (kind, tag, href) in enumerate(parser.events):
        if tag == "a" and kind == "begin":
            opened.append((i, href))
        elif tag == "a" and kind == "end" and opened:
            begin, href = opened.pop()
            address = urllib.parse.urljoin(base, href) if href else ""
            if re.match("https?://", address):
                target[i], begins[begin] = address, i
    unseen, buffers = 0, [[]]
    for i, (kind, tag, _) in enumerate(parser.events):
        if kind == "text":
            if not unseen:
                buffers[-1].append(tag)
        elif tag in UNSEEN:
            unseen = max(0, unseen + (1 if kind == "begin" else -1))
        elif i in begins:
            buffers.append([])
        elif i in target:
            inner = "".join(buffers.pop())
            label = " ".join(inner.split())
            buffers[-1].append(f"[{label}]({target[i]})" if label else inner)
        elif tag in LINES:
            buffers[-1].append("\n" + ("#" * int(tag[1]) + " " if kind == "begin" and tag[0] == "h" and tag[1:].isdigit() else ""))
    lines = "\n".join(" ".join(line.split()) for line in "".join(itertools.chain(*buffers)).splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


@F.pandas_udf(StringType())
def readable(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_text(p, b or "") for p, b in zip(page, base, strict=True)], dtype="object")
