"""Sentence boundaries across languages and scripts.

Every character is tagged as the end of a unit or inside one. In punctuated text only the
characters after which a unit can end (terminal marks with their closing quotes and brackets, line
breaks, spaces in Thai) have a choice; in text of a script without spaces that carries no marks,
every character has one. A linear chain scores the tags by the context before and after each place
and by the tag before, and Viterbi decoding takes the best sequence of a text.

Nothing is labelled, so the chain learns from what is sure:

1. Ends of lines are ends of units. Over all texts it is counted how often a word stands before a
   mark, and how often at a sure end; how often a word occurs, and how often at a sure start. The two
   rates that tell sentence words from others are fitted to these counts by expectation maximisation.
2. Viterbi training: the first tags come from these ratios alone; emissions of the places (kind, case,
   context) and transitions (tag before, distance) are then counted from the tags of the whole corpus.
3. For scripts without spaces the marks are stripped from punctuated text and their places are the
   labels: what characters end and begin sentences, and how long sentences are. Text without marks is
   decoded with these counts by a chain whose transitions depend on the length so far.

Texts are read by Python once, where contexts are folded per batch; they are summed, looked up and put together by the JVM.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lexmill.functions.session import written

#: Scores of contexts are clipped to this, in half steps.
LIMIT = 6.0
#: Contexts with at least one such part of all counts, so at most that many, are looked up by a broadcast, all others by a shuffle.
HEAVY_SHARE = 50_000
#: Pseudo-counts that keep a learnt score finite, and length up to which sentences of unmarked text are told apart.
SMOOTH, LONGEST = 0.5, 160
#: Counts that the parts of a cell weigh beside the counts of the cell itself.
LEAN = 4.0
#: Distances to the place before that have transitions of their own, in characters.
NEAR = (3, 12, 40)
#: A line break is a wrap if the next word would not have fitted; texts of longer lines are not wrapped.
WRAP_WIDTH = (40, 110)

# Marks, brackets and headings.
STRONG = "!?。！？｡؟।॥។៕።"
WEAK = ".．…"
CLOSERS = "\"'”’»›“)]）】」』〕》*_"
PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "„": "“", "‹": "›"}
HEADING = re.compile(
    r"[ \t]*(?:(?:Điều|Chương|Mục|Khoản|Phần|Phụ lục|Article|Art\.?|Chapter|Section|Annex|§|Статья|Artikel|มาตรา)[  ]*[\w.]*?[\w][.:)]?(?=\s)"
    r"|[-–—•*+](?=\s)|\(?(?:\d{1,3}(?:\.\d{1,3})*|[a-zđA-Z]|[ivxlc]{1,5}|[IVXLC]{1,6})[.)](?=\s))[ \t ]*"
)
_mark = re.compile(rf"[{re.escape(STRONG + WEAK)}]+")
_breaks = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_word = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
_letters = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_numbers = re.compile(r"\d+(?:[.,]\d+)*(?:[  ]+([^\W\d_]+)(?:[  ]+([^\W\d_]+))?)?")
_space = re.compile(r"\s")
_gap = re.compile(r"\s*")
_digit = re.compile(r"\d")
_beside_number = re.compile(r"[^\d.,:/%]")
_bracket = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]")
_label = re.compile(r"[^\W\d_]+(?: [^\W\d_]+){0,3}[:：]\s+")
_whole_word = re.compile(r"(?<![^\W_])[a-zà-öø-ÿăđĩũơưạ-ỹа-я]{3,}\Z")
_two_words = re.compile(r"[  ]+([^\W\d_]+)(?:[  ]+([^\W\d_]+))?")
_first_word = re.compile(r"\s*(\S+)")
_thai = re.compile(r"(?<=[฀-๿])[  ]+(?=[฀-๿])")
_abbreviation_thai = re.compile(r"[฀-๿]\.\Z")
_abbreviation_after = re.compile(r"[฀-๿]{1,3}\.")


def _spaceless(ch: str) -> int:
    """Leading characters that stand for a word in a script without spaces; 0 for other scripts."""
    return 2 if "぀" <= ch <= "鿿" or "㐀" <= ch <= "䶿" else 5 if "฀" <= ch <= "໿" or "ក" <= ch <= "៿" else 0


def _first(text: str, at: int) -> str:
    """Key of what begins at a position: its first word, or leading characters; a number with the two words after it."""
    while at < len(text) and (text[at] in PAIRS or text[at] in "\"'¿¡*_ \t "):
        at += 1
    if at >= len(text):
        return ""
    if n := _spaceless(text[at]):
        return text[at : at + n]
    m = _word.match(text, at)
    if not m:
        return text[at]
    if m[0][0].isdigit():
        after = _two_words.match(text, m.end())
        return f"# {after[1]} {after[2] or ''}" if after else "#"
    return m[0]


def _last(text: str, start: int, at: int) -> str:
    """Key of the word before a mark, with the marks inside it; numbers are one class, codes another."""
    near = text[max(start, at - 64) : at]
    if start < at - 64 and not _space.search(near):
        near = text[start:at]
    if not near or near[-1].isspace():
        return ""
    word = near.rsplit(None, 1)[-1].lstrip("“«(\"'[„").lower()
    if _digit.search(word):
        return "#a" if _beside_number.search(word) else "#"
    return word


def _lines(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether the break after it is a wrap) of each line."""
    spans, at = [], 0
    for m in _breaks.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    lengths = [len(text[a:b].rstrip()) for a, b in spans]
    width = max(lengths)
    joins = []
    for (a, b), (c, d), n, following in zip(spans, spans[1:], lengths, lengths[1:]):
        if n and following:
            m = _first_word.match(text, c, d)
            joins.append(n + 1 + len(m[1]) > width if m else False)
        else:
            joins.append(None)
    known = [j for j in joins if j is not None]
    wrapped = known and WRAP_WIDTH[0] <= width <= WRAP_WIDTH[1] and sum(known) >= 0.9 * len(known)
    return [(a, b, bool(wrapped and j)) for (a, b), j in zip(spans, [*joins, False])]


def _quoted(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans between matching quotes and brackets of one paragraph; what is never closed is not open."""
    spans, stack = [], []
    straight = None
    for m in _bracket.finditer(text, start, end):
        i, ch = m.start(), m[0]
        if ch == '"':
            if straight is None:
                straight = i
            else:
                spans.append((straight, i))
                straight = None
        elif stack and ch == PAIRS[text[stack[-1]]]:
            spans.append((stack.pop(), i))
        elif ch in PAIRS:
            stack.append(i)
        elif any(PAIRS[text[j]] == ch for j in stack):
            while PAIRS[text[stack[-1]]] != ch:
                stack.pop()
            spans.append((stack.pop(), i))
    return spans


def _places_of(text: str, start: int, end: int) -> Iterator[tuple]:
    """Each place of a paragraph where a unit may end: (end, kind, before, after, inside).

    ``end``: characters up to and with the mark and its closers; kind: ``break`` (sure), ``strong``, ``weak``,
    ``dots``, ``closed`` (closers after the mark), ``joined`` (no space after a weak mark), ``space`` (Thai);
    before, after: keys of the words around it; inside: within quotes or brackets that close later.
    """
    stop = start + len(text[start:end].rstrip())
    if not text[start:stop].strip():
        return
    spans = _quoted(text, start, stop)
    head = HEADING.match(text, start, stop)
    body = head.end() if head else start
    found = []
    guillemets = text.find("»", start, stop) >= 0 or text.find("›", start, stop) >= 0
    for m in _mark.finditer(text, start, stop):
        at, mark = m.end(), m[0]
        if at <= body or mark == "." and at < stop and (text[at].isdigit() or text[at].islower()):
            continue
        closed = at
        while closed < stop and (guillemets or text[closed] in CLOSERS):
            after = closed
            while after < stop and text[after] in "   ":
                after += 1
            if after < stop and text[after] in "»›" and after > closed or closed < stop and text[closed] in CLOSERS and not (text[closed] == "“" and not any(b == closed for _, b in spans)) and not (text[closed] == '"' and any(a == closed for a, _ in spans)):
                closed = (after if text[closed] in "   " else closed) + 1
            else:
                break
        if closed >= stop:
            continue
        strong = any(ch in STRONG for ch in mark)
        dots = not strong and ("…" in mark or len(mark) > 1)
        spaced = text[closed].isspace()
        inside = bool(spans) and any(a < m.start() and b >= closed for a, b in spans)
        nx = _gap.match(text, closed, stop).end()
        before, after, nxt = _last(text, start, m.start()), _first(text, nx), text[nx : nx + 2]
        if closed > at:
            kind = "closed"
        elif strong:
            kind = "strong"
        elif dots:
            kind = "dots"
        elif spaced:
            kind = "weak"
        elif text[m.start() - 1 : m.start()].isupper() or not (nxt[:1].isupper() and (nxt[1:].islower() or nxt[1:].isspace())) or not (text[m.start() - 1 : m.start()].isalnum() or text[m.start() - 1 : m.start()] in "%²³)”»½"):
            continue
        else:
            kind = "joined"
        found.append((closed, kind, before, after, inside))
    for m in _thai.finditer(text, body, stop):
        near = text[max(start, m.start() - 3) : m.start()]
        figure = any(ch.isdigit() for ch in (text[m.start() - 1], text[m.end()])) or _abbreviation_thai.search(near) or _abbreviation_after.match(text, m.end())
        quote = any(a <= m.start() <= b for a, b in spans)
        if not figure and not quote:
            found.append((m.start(), "space", "", _first(text, m.end()), False))
    yield from sorted(found)
    yield stop, "break", _last(text, start, stop - 1) if text[stop - 1] in WEAK else "", "", False


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of lines that are wrapped into one."""
    lines, first = _lines(text), 0
    while first < len(lines):
        last = first
        while last < len(lines) - 1 and lines[last][2]:
            last += 1
        yield lines[first][0], lines[last][1]
        first = last + 1


#: Letters of scripts without spaces, in Java and Python; a gap between two of them has their neighbours as context.
RUN = "぀-ヿ㐀-䶿一-鿿฀-๎ກ-ໟក-៓"
_GRAM = {"wide": ("぀-ヿ㐀-䶿一-鿿", 2), "southeast": ("฀-๎ກ-ໟក-៓", 3)}
_run = re.compile(f"[{RUN}]{{2,}}")
_any_mark = re.compile(rf"[{re.escape(STRONG + WEAK)}]")


#: Where a sentence of such a script ends for certain, and what is stripped from it besides: all that is no letter, mark or digit.
_unit_end = re.compile(rf"[{re.escape('!?。！？｡؟।॥។៕')}]+[\"'”’»›)）】」』〕》]*\s*|(?<=[฀-๿])[  ]+(?=[฀-๿])|[\r\n]+")
_marked_run = re.compile("[。！？｡។៕]|[฀-๿][  ]+[฀-๿]")
_sign = re.compile(rf"[^\w\x01{RUN}]+|_")


def _bare_gaps(text: str) -> Iterator[tuple]:
    """(end, before, after) of each gap within runs of text that carries no marks at all and is mostly of scripts without spaces."""
    if _any_mark.search(text) or not _run.search(text) or _thai.search(text):
        return
    for start, stop in _paragraphs(text):
        runs = list(_run.finditer(text, start, stop))
        if 2 * sum(m.end() - m.start() for m in runs) < sum(map(str.isalpha, text[start:stop])):
            continue
        for m in runs:
            g = 2 if _spaceless(m[0][0]) == 2 else 3
            for at in range(m.start() + 1, m.end()):
                yield at, "\x02" + text[max(m.start(), at - g) : at], "\x02" + text[at : min(m.end(), at + g)]


def _case(after: str) -> str:
    """Class of what follows a place."""
    if not after:
        return "-"
    first = after[0]
    if first == "#":
        return "#" if after == "#" else "n"
    if not first.isalnum() and first not in "-–—$€§" and unicodedata.category(first)[0] == "P":
        return "p"
    return "l" if first.islower() else "u" if first.isupper() else "o"


_COLUMNS = ("at", "kind", "before", "after", "n")
_CONTEXTS = ("mark", "end", "word", "start")


class _Words(dict):
    """Words of runs without white space; those of short runs are remembered, up to a number that no memory minds."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        found = tuple(_letters.findall(token))
        if len(token) <= 40 and len(self) < 200_000:
            self[token] = found
        return found


_words_of = _Words()


def _rows(text: str, seen: dict[str, Counter]) -> Iterator[tuple]:
    """Places of a text as (end, kind and case, before, after, None); punctuated text of a script without spaces also stripped, U+0001 where a sentence ends.

    ``seen`` counts the text's contexts by kind: words before a mark, in all (``mark``) and at sure ends (``end``); words in
    all (``word``) and at sure starts (``start``). A text counts once for each, so that no long or monotonous text outweighs the others.
    """
    marks, ends, starts = set(), set(), set()
    for start, stop in _paragraphs(text):
        for end, kind, before, after, inside in _places_of(text, start, stop):
            if inside:
                yield end, "inside", "", "", None
                continue
            if kind == "break":
                if before:
                    marks.add(before)
                    ends.add(before)
                yield end, kind, "", "", None
                continue
            weak = kind in ("weak", "joined")
            if before and weak:
                marks.add(before)
            # Sure starts too: after a strong mark, and after a full stop that ends a whole lower-case word.
            if after and (kind == "strong" or weak and _whole_word.search(text, max(0, end - 20), end - 1)):
                starts.add(after)
            case = _case(after)
            yield end, f"{kind} {case}", before if weak else "", "" if case in "p#" else after, None
        head = HEADING.match(text, start, stop)
        body = head.end() if head else start
        while body < stop and text[body].isspace():
            body += 1
        label = _label.match(text, body, stop)
        starts.update(_first(text, at) for at in {body, label.end() if label else body} if at < stop)
    for end, before, after in _bare_gaps(text):
        yield end, "bare", before, after, None
    words = set().union(*map(_words_of.__getitem__, set(text.split())))
    words.update(f"# {a} {b}" if a else "#" for a, b in set(_numbers.findall(text)))
    if _run.search(text):
        if _marked_run.search(text):
            yield None, "stripped", "", _sign.sub("", _unit_end.sub("\x01", text)), None
        # A run without marks: each place in it could be a beginning.
        runs = {w for w in words if _spaceless(w[0])}
        words = (words - runs) | {w[i : i + n] for w in runs for n in [_spaceless(w[0])] for i in range(len(w))}
    for kind, keys in (("mark", marks), ("end", ends), ("start", starts), ("word", words)):
        seen[kind].update(keys)


def _placed(texts: DataFrame) -> DataFrame:
    """``k, h1, h2`` and the columns of ``_rows`` of texts ``k, h1, h2, t``; contexts as ``kind, after, n``, folded per batch of texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, origin, found = {kind: Counter() for kind in _CONTEXTS}, [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                rows = list(_rows(text, seen))
                found += rows
                origin += [i] * len(rows)
            contexts = [(None, kind, "", key, n) for kind, of in seen.items() for key, n in of.items() if key]
            found += contexts
            origin += [None] * len(contexts)
            columns = list(zip(*found)) or [()] * len(_COLUMNS)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            at = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("k", "h1", "h2")] + [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["k", "h1", "h2", *_COLUMNS])

    kind = texts.schema["k"].dataType.simpleString()
    return texts.mapInArrow(read, f"k {kind}, h1 long, h2 long, at int, kind string, before string, after string, n long")


def _fitted(contexts: DataFrame) -> tuple[float, float]:
    """Rates of sure cases in contexts ``key, n, k`` that have them as a matter of course, and in those that have them by chance.

    A mixture of two binomials fitted by expectation maximisation. Contexts come to the driver as a
    histogram over quarter octaves of n and k: some thousand rows at most, however many contexts there are.
    """
    octave = lambda c: F.floor(4 * F.log2(F.col(c) + 1))
    bins = contexts.groupBy(octave("n").alias("bn"), octave("k").alias("bk")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k")).collect()
    high, low, share = 0.15, 0.002, 0.5
    if not bins:
        return high, low
    m, n, k = (np.array([float(r[c]) for r in bins]) for c in ("m", "n", "k"))
    n = np.maximum(n, k)
    for _ in range(20):
        ratio = (k * math.log(high / low) + (n - k) * math.log((1 - high) / (1 - low))) / m
        own = 1 / (1 + np.exp(-np.clip(ratio + math.log(share / (1 - share)), -50, 50)))
        high = min(max(float((own * k).sum() + 0.15) / float((own * n).sum() + 1), 0.01), 0.9)
        low = min(max(float(((1 - own) * k).sum() + 0.002) / float(((1 - own) * n).sum() + 1), 1e-4), high / 5)
        share = min(max(float((own * m).sum() / m.sum()), 0.01), 0.99)
    return high, low


def _ratios(contexts: DataFrame) -> DataFrame:
    """``key, n, score`` of contexts ``key, n, k``: log likelihood ratio of the two fitted rates, clipped, in half steps."""
    high, low = _fitted(contexts)
    k, n = F.col("k"), F.greatest("n", "k")
    ratio = k * math.log(high / low) + (n - k) * math.log((1 - high) / (1 - low))
    return contexts.select("key", "n", (F.round(2 * F.greatest(F.least(ratio, F.lit(LIMIT)), F.lit(-LIMIT))) / 2).cast("float").alias("score"))


def _gram_scores(stripped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, n, score`` of the characters before, and after, a gap in text without marks, counted on stripped texts."""

    def events(name: str, letters: str, n: int) -> list[Column]:
        found = lambda pattern, i: F.regexp_extract_all("s", F.lit(pattern.replace("@", f"[{letters}]{{{n}}}")), F.lit(i))
        told = lambda grams, k: F.transform(grams, lambda g: F.struct(F.lit(name).alias("script"), g.alias("g"), *[F.lit(int(i == k)).alias(c) for i, c in enumerate("cba")]))
        ends = "(?<=(@))\x01+(?=(@))"
        return [told(found("(?=(@))", 1), 0), told(found(ends, 1), 1), told(found(ends, 2), 2)]

    every = F.concat(*[x for name, (letters, n) in _GRAM.items() for x in events(name, letters, n)])
    grams = written(stripped.select(F.explode(every).alias("e")).groupBy("e.script", "e.g").agg(*[F.sum(F.col("e")[c]).alias(c) for c in "cba"]), "grams")
    totals = {r.script: r for r in grams.groupBy("script").agg(*[F.sum(c).alias(c) for c in "cba"], F.count(F.lit(1)).alias("v")).collect()}

    def scored(side: str) -> DataFrame:
        rate = F.lit(None).cast("double")
        for name, t in totals.items():
            near = F.log((F.col(side) + 0.1) / (t[side] + 0.1 * t.v)) - F.log((F.col("c") + 0.1) / (t.c + 0.1 * t.v))
            rate = F.when(F.col("script") == name, near).otherwise(rate)
        return grams.select(F.concat(F.lit("\x02"), "g").alias("key"), F.col("c").alias("n"), F.greatest(F.least(rate, F.lit(LIMIT)), F.lit(-LIMIT)).cast("float").alias("score"))

    return scored("b"), scored("a")


def _lengths(stripped: DataFrame) -> np.ndarray:
    """Log probability of a sentence's length in characters, from 0 to ``LONGEST`` (that and more)."""
    parts = F.filter(F.split("s", "\x01+"), lambda x: F.length(x) > 0)
    seen = stripped.select(F.explode(F.transform(parts, lambda x: F.least(F.length(x), F.lit(LONGEST)))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()
    counts = np.zeros(LONGEST + 1)
    for r in seen:
        counts[r.n] = r.c
    # Neighbouring lengths lend each other their counts.
    smooth = np.convolve(counts, np.ones(5) / 5, "same") + SMOOTH
    return np.log(smooth / smooth.sum())


def _looked_up(rows: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Rows with ``<column>_score`` of the context in each column; null where there is none.

    Contexts with a ``HEAVY_SHARE``-th of all counts or more meet their rows by a broadcast where these lie;
    only rows that have another context left are shuffled, once per column.
    """
    rare, missing = {}, F.lit(False)
    for column, table in scores.items():
        total = table.agg(F.sum("n")).first()[0] or 0
        named = table.select(F.col("key").alias(column), F.col("score").alias(f"{column}_score"), (F.col("n") * HEAVY_SHARE >= total).alias("heavy"))
        rows = rows.join(F.broadcast(named.where("heavy").drop("heavy")), column, "left")
        rare[column] = named.where("not heavy").select(column, F.col(f"{column}_score").alias("_score"))
        missing = missing | (F.col(column) != "") & F.col(f"{column}_score").isNull()
    rows = written(rows.withColumn("rare", missing), "scored")
    rest = rows.where("rare")
    for column, table in rare.items():
        rest = rest.join(table, column, "left").withColumn(f"{column}_score", F.coalesce(f"{column}_score", "_score")).drop("_score")
    return rows.where("not rare").unionByName(rest).drop("rare")


def _seed(kind: str, before: float, after: float) -> float:
    """First score of the tag boundary against inside: before anything is learnt, from the context's ratios alone."""
    name, _, case = kind.partition(" ")
    if name == "inside" or case == "p":
        return -20.0
    if name == "space":
        return 8.0
    follows = -LIMIT if case == "#" else after
    if name == "strong":
        return -4.0 if case == "l" else 6.0 + 0.3 * follows
    lead = 1.5 * before if name in ("weak", "joined") else 0.0
    return lead + follows + {"l": -6.0, "u": 1.0}.get(case, 0.0) - 0.5


class Chain:
    """Scores of the cells (kind with case, before, after) and of transitions; Viterbi decoding."""

    def __init__(self, gains: list[float], lengths: np.ndarray, near: list[list[float]] | None = None):
        self.gains, self.lengths = gains, lengths
        # near[distance class][tag before]: what a boundary at that distance gains.
        self.near = near or [[0.0, -4.0]] + [[0.0, 0.0]] * len(NEAR)

    def tags(self, ends, cells, bare) -> list[bool]:
        """Tag of each place of a text; cell -1 is a sure boundary, -2 a gap of unmarked text with its own score."""
        return self._unmarked(ends, cells, bare) if -2 in cells else self._marked(ends, cells)

    def _marked(self, ends, cells) -> list[bool]:
        out, last = [], 1
        inside, boundary, paths, previous = -math.inf, 0.0, [], 0
        for end, cell in zip(ends, cells):
            gap = end - previous
            near = self.near[0 if gap <= NEAR[0] else 1 if gap <= NEAR[1] else 2 if gap <= NEAR[2] else 3]
            gain, (from_inside, from_boundary) = (100.0, (0.0, 0.0)) if cell == -1 else (self.gains[cell], near)
            x, y = inside + from_inside, boundary + from_boundary
            paths.append((inside < boundary, x < y))
            inside, boundary = (boundary if inside < boundary else inside), (y if x < y else x) + gain
            previous = end
        tag = boundary >= inside
        for back in reversed(paths):
            out.append(tag)
            tag = back[tag]
        return out[::-1]

    def _unmarked(self, ends, cells, bare) -> list[bool]:
        """Sure boundaries, and between them the best cut of each stretch: scores of its gaps and of the sentences' lengths."""
        tags, first, start = [c == -1 for c in cells], 0, 0
        for i, (end, cell) in enumerate(zip(ends, cells)):
            if cell == -1:
                for j in self._cut([start, *ends[first:i], end], bare[first:i]):
                    tags[first + j] = True
                first, start = i + 1, end
        return tags

    def _cut(self, places: list[int], scores) -> list[int]:
        at, n = np.array(places), len(places)
        gain = np.concatenate([[0.0], np.asarray(scores, dtype=float), [0.0]])
        best, back, slope = np.zeros(n), np.zeros(n, dtype=int), 0.1
        older, which = -math.inf, 0
        for j in range(1, n):
            low = max(0, j - LONGEST)
            if low:
                # Whatever lies further back than the longest length falls off by a constant slope.
                value = best[low - 1] + slope * at[low - 1]
                older, which = (value, low - 1) if value > older else (older, which)
            span = at[j] - at[low:j]
            value = best[low:j] + self.lengths[np.minimum(span, LONGEST)] - slope * np.maximum(span - LONGEST, 0)
            k = int(value.argmax())
            best[j], back[j] = value[k], low + k
            if older + self.lengths[LONGEST] - slope * (at[j] - LONGEST) > best[j]:
                best[j], back[j] = older + self.lengths[LONGEST] - slope * (at[j] - LONGEST), which
            best[j] += gain[j]
        out, j = [], back[n - 1]
        while j > 0:
            out.append(j - 1)
            j = back[j]
        return out


def _decoded(texts: DataFrame, chain: Chain) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(ArrayType(BooleanType()))
    def tags(ends: pd.Series, cells: pd.Series, bare: pd.Series) -> pd.Series:
        return pd.Series([shared.value.tags(e.tolist(), c.tolist(), b) for e, c, b in zip(ends, cells, bare)])

    part = lambda c: F.transform("places", lambda x: x[c])
    return texts.withColumn("tags", tags(part("at"), part("cell"), part("bare")))


def _log_ratio(a: float, b: float, of_a: float, of_b: float) -> float:
    return math.log((a + SMOOTH) / (of_a + 2 * SMOOTH)) - math.log((b + SMOOTH) / (of_b + 2 * SMOOTH))


def _learnt(decoded: DataFrame, cells: list, lengths: np.ndarray) -> Chain:
    """Chain whose emissions and transitions are counted from tagged texts: the cells' and the distances' counts, a bounded table, come to the driver."""
    zipped = F.transform(F.arrays_zip("places", "tags"), lambda x: F.struct(x["places"]["at"].alias("at"), x["places"]["cell"].alias("cell"), x["tags"].alias("tag")))
    all_tags = decoded.where(F.size("places") > 0).select(zipped.alias("z"))

    def before(i: Column, field: str, none) -> Column:
        return F.when(i > 0, F.try_element_at("z", i)[field]).otherwise(none)

    steps = F.transform("z", lambda x, i: F.struct(x["cell"].alias("cell"), x["tag"].alias("tag"), before(i, "tag", F.lit(True)).alias("last"), (x["at"] - before(i, "at", F.lit(0))).alias("gap")))
    gap = F.when(F.col("s.gap") <= NEAR[0], 0).when(F.col("s.gap") <= NEAR[1], 1).when(F.col("s.gap") <= NEAR[2], 2).otherwise(3)
    counts = all_tags.select(F.explode(F.filter(steps, lambda x: x["cell"] >= 0)).alias("s")).groupBy("s.cell", "s.tag", "s.last", gap.alias("gap")).agg(F.count(F.lit(1)).alias("n")).collect()
    kinds: dict = {}
    values: dict = {}
    joint: dict = {}
    gaps = np.zeros((len(NEAR) + 1, 2, 2))
    totals = [0.0, 0.0]
    for r in counts:
        kind, b, a = cells[r["cell"]]
        tag, n = int(r["tag"]), r["n"]
        totals[tag] += n
        gaps[r["gap"], int(r["last"]), tag] += n
        kinds.setdefault(kind, [0.0, 0.0])[tag] += n
        joint.setdefault((kind, b, a), [0.0, 0.0])[tag] += n
        name = kind.partition(" ")[0]
        for side, x in (("before", b), ("after", a)):
            values.setdefault((name, side, x), [0.0, 0.0])[tag] += n
            values.setdefault((name, side), [0.0, 0.0])[tag] += n

    def gain(kind: str, b: float, a: float) -> float:
        score = math.log((kinds[kind][1] + SMOOTH) / (kinds[kind][0] + SMOOTH)) if kind in kinds else 0.0
        name = kind.partition(" ")[0]
        for side, x in (("before", b), ("after", a)):
            no, yes = values.get((name, side, x), (0.0, 0.0))
            all_no, all_yes = values.get((name, side), (0.0, 0.0))
            score += _log_ratio(yes, no, all_yes, all_no)
        # A cell seen often enough speaks for itself; one seen rarely leans on what its parts tell.
        share = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        no, yes = joint.get((kind, b, a), (0.0, 0.0))
        return math.log((yes + LEAN * share + 1e-9) / (no + LEAN * (1 - share) + 1e-9))

    prior = math.log((totals[1] + SMOOTH) / (totals[0] + SMOOTH))
    near = [[math.log((g[1] + 5 * (totals[1] + SMOOTH) / (sum(totals) + 1)) / (g[0] + 5 * (totals[0] + SMOOTH) / (sum(totals) + 1))) - prior for g in of] for of in gaps]
    return Chain([gain(*c) for c in cells], lengths, near)


def sentence_ends(docs: DataFrame, key: str, text: str = "text", training: DataFrame | None = None) -> DataFrame:
    """``key, ends``: array of the ends of each text's units, in code points; texts without visible characters have no row.

    - Rows of equal key and text come out once; null keys and equal keys with different texts stay rows of their own.
    - ``training``: texts (column ``text``) that the chain learns from; by default ``docs`` itself. Other columns are ignored.
    - Null, empty and blank texts have no units; an empty table gives no rows.
    - Counts cover all texts and contexts; none is dropped. What comes to the driver has a bound that does not
      depend on the data: a histogram, the cells' and distances' counts, the lengths up to ``LONGEST``.
    """
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S")).withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")}).select("k", "h1", "h2", "t")
    placed = written(_placed(texts), "places")
    if training is None:
        learnt_places = placed
    else:
        learnt_texts = training.select(F.monotonically_increasing_id().alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S")).withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")}).select("k", "h1", "h2", "t")
        learnt_places = written(_placed(learnt_texts), "places")
    before, after, lengths = _evidence(learnt_places)
    cells, trained = _grouped(learnt_places, before, after)
    first = Chain([_seed(*c) for c in cells], lengths)
    chain = _learnt(_decoded(trained, first), cells, lengths)
    if training is not None:
        new_cells, trained = _grouped(placed, before, after)
        known = dict(zip(cells, chain.gains))
        chain = Chain([known.get(c, _seed(*c)) for c in new_cells], lengths, chain.near)
    found = F.filter(F.transform(F.arrays_zip("places", "tags"), lambda x: F.when(x["tags"], x["places"]["at"])), lambda x: x.isNotNull())
    return _decoded(trained, chain).select(F.col("k").alias(key), found.alias("ends"))


def _evidence(placed: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Scores ``key, n, score`` of the contexts before and after a place, and the lengths of sentences, from all texts."""
    contexts = placed.where("at is null and kind <> 'stripped'").groupBy(F.col("after").alias("key")).pivot("kind", list(_CONTEXTS)).agg(F.sum("n")).fillna(0)
    contexts = written(contexts, "contexts")
    # A number says little: it ends sentences, dates and ordinals alike.
    before = _ratios(contexts.where("mark > 0").select("key", F.col("mark").alias("n"), F.col("end").alias("k"))).withColumn("score", F.when(F.col("key") == "#", F.least("score", F.lit(2.0).cast("float"))).otherwise(F.col("score")))
    after = _ratios(contexts.where("word + start > 0").select("key", F.col("word").alias("n"), F.col("start").alias("k")))
    stripped = placed.where("kind = 'stripped'").select(F.col("after").alias("s"))
    before_gap, after_gap = _gram_scores(stripped)
    return before.unionByName(before_gap), after.unionByName(after_gap), _lengths(stripped)


def _grouped(placed: DataFrame, before: DataFrame, after: DataFrame) -> tuple[list, DataFrame]:
    """Cells (kind, before, after) that occur, and ``k, h1, h2, places`` of each text: its places in order with the numbers of their cells."""
    rows = placed.where("at is not null")
    sure = F.col("kind") == "break"
    none = F.lit(None).cast("float")
    open_places = _looked_up(rows.where(~sure), {"before": before, "after": after})
    x = open_places.select("k", "h1", "h2", "at", "kind", F.coalesce("before_score", F.lit(0.0)).cast("float").alias("b"), F.coalesce("after_score", F.lit(0.0)).cast("float").alias("a"))
    both = x.unionByName(rows.where(sure).select("k", "h1", "h2", "at", "kind", F.lit(0.0).cast("float").alias("b"), F.lit(0.0).cast("float").alias("a")))
    cells = [tuple(r) for r in x.where("kind <> 'bare'").select("kind", "b", "a").distinct().orderBy("kind", "b", "a").collect()]
    numbered = placed.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(cells)], "kind string, b float, a float, cell int")
    told = both.join(F.broadcast(numbered), ["kind", "b", "a"], "left").withColumn("cell", F.coalesce("cell", F.when(sure, -1).otherwise(-2)))
    place = F.struct("at", "cell", F.when(F.col("cell") == -2, F.col("a") + F.col("b")).otherwise(none).alias("bare"))
    # Decoded twice, to learn and to tag, but put together once.
    return cells, written(told.groupBy("k", "h1", "h2").agg(F.array_sort(F.collect_set(place)).alias("places")), "chains")


def sentence_units(docs: DataFrame, key: str, text: str = "text", training: DataFrame | None = None) -> DataFrame:
    """``key, sent_no, sent_end``: one row per unit of each distinct (key, text); texts without visible characters have none."""
    return sentence_ends(docs, key, text, training).select(key, F.posexplode("ends").alias("n", "sent_end")).select(key, (F.col("n") + 1).alias("sent_no"), "sent_end")
