"""Problem 2: noise in text from scanned pages.

Method: noisy-channel correction. One scan counts the corpus' words, word pairs, compounds and lone signs and the
shapes of the lines at the pages' edges. The words are judged in buckets of equal strokes, which hold all readings
of a word: what each may be a reading of, and the rates of the character confusions. A second scan passes every
run of words that is not plainly right to the decoder, which joins the entries of the run's words and the counts
of the pairs that their readings could form, and takes the likeliest words by Viterbi. A sign that stands alone
is noise where leaving it out is likelier, for its kind of neighbours or for the two themselves, than printing it.

All counts are exact tables, joined by word or pair; LEAST is the one floor. What is broadcast only spares work:
the words and pairs of at least ``SHARE`` of the corpus, so never more than 1 / SHARE of each. A run of words and
its two neighbours is decoded once, however often it stands in the corpus.

Page matter (running heads and feet, page numbers) is found by position and repetition: a line at the edge
whose shape keeps to the edges of pages and comes back on other pages of its document or in other documents,
has the form of a page number, or repeats the title or journal of its document. It is one line or two at the head
and one at the foot, so the first body line is among the first three lines that are not empty. Words broken at a
line's end are joined with the next body line, on the next page if need be; counts of the joined word and of the
compound tell a break from a compound's own hyphen.

Whole pages stay in the scan's tasks: what is shuffled are counts, edge lines, runs and the found places. A volume
with a tenth of all pages is therefore spread like any other pages.

Defined results: a null page text has no lines; a page written twice counts once; lines keep their numbers, empty
ones included; a mark at the end of a document's last line is no break; a break goes on at most to the next page;
a sign beside a word belongs to it and stays, and so does a bracket or quote with its partner; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import channel
from quire.llm.channel import DIGITS, LEAST, WORD, Reader, fold, shape, tokens
from quire.session import cut, spread

SHARE = 1e-5
# Log odds, a place and in all, from which a kind of lone sign is noise; and from which a single place of such a sign is.
MARGIN, WEIGHT, CLEAR = 0.2, 3.0, 2.0
MARKS = "-‐¬\xad"
BROKEN = re.compile(rf"([^\W_]+)([{MARKS}])\s*$")
ACROSS = re.compile(rf"[{MARKS}][ \t]*\n\s*(?=[^\W_])")
INNER = re.compile(r"[-‐](?=[^\W_])")
LEFT, RIGHT = re.compile(r"[^\W_]+$"), re.compile(r"[^\W_]+")
FIRST = re.compile(r"^\W*?([^\W_]+)")
LONE = re.compile(r"(?<!\S)(?:[^\w\s]|_)(?!\S)")
NEAR = 200  # characters between a bracket or quote and its partner
NUMBER_FORM = re.compile(r"(?:(?:page|p|s|seite|pag|pagina)\b[ .]*)?#(?: (?:of|de|von|/) #)?")
ROMAN = re.compile(r"[ivxlc1]{1,7}")
ET_AL = re.compile(r"^\W*(?:[\w]{1,5}\s+)?[^\W\d_]+ et a[l1i]\b\.?(?:\s*$|\s+[-–]\s|\s{2,})", re.I)
# Signs that come in pairs, in either order.
PARTNERS = {a: b for x, y in ("«»", "‹›", "()", "[]", "{}", "„“", "“”", "‘’") for a, b in ((x, y), (y, x))}
FACTS = "kind string, a string, b string, doc long, page int, line int, n long"
STARTS = 4


def _without_broken(text: str) -> str:
    """The text without words that go on in the next line, so their parts are not counted as words."""
    kept, done = [], 0
    for m in ACROSS.finditer(text):
        left = LEFT.search(text, max(done, m.start() - 200), m.start())
        if left:
            kept.append(text[done : left.start()])
            done = RIGHT.match(text, m.end()).end()
    return "\n".join([*kept, text[done:]])


def _compounds(text: str) -> Iterator[tuple[str, str]]:
    """Both words at each hyphen inside a line."""
    for m in INNER.finditer(text):
        left = LEFT.search(text, max(0, m.start() - 40), m.start())
        if left:
            yield left.group(), RIGHT.match(text, m.end()).group()


def _lone(text: str) -> list[tuple[str, str, str, int]]:
    """Each lone sign without a partner, the words before and after it, and its line."""
    signs, open_, line, at = [], {}, 1, 0
    for m in LONE.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        signs.append((m.group(), m.start(), line))
        partner = PARTNERS.get(m.group())
        if partner in open_ and at - signs[open_[partner]][1] <= NEAR:
            signs[open_.pop(partner)] = signs[-1] = None
        elif partner:
            open_[m.group()] = len(signs) - 1
    out = []
    for sign, at, line in filter(None, signs):
        before, after = WORD.findall(text, max(0, at - NEAR), at), WORD.search(text, at + 1)
        out.append((sign, channel.token(before[-1]) if before else "", channel.token(after.group()) if after else "", line))
    return out


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one task and the edge lines of its pages (with their shapes' hashes, by which shapes are counted)."""
    raw, pairs, compounds, inside, signs = (Counter() for _ in range(5))

    def counted() -> pd.DataFrame:
        words = Counter()
        for w, n in raw.items():
            words[channel.token(w)] += n
        rows = [("word", w, "", None, None, None, n) for w, n in words.items()]
        rows += [("number", w, "", None, None, None, n) for w, n in raw.items() if len(w) <= 4 and w.isdigit()]
        rows += [("pair", a, b, None, None, None, n) for (a, b), n in pairs.items()]
        rows += [("compound", a, b, None, None, None, n) for (a, b), n in compounds.items()]
        rows += [("inside", str(s), "", None, None, None, n) for s, n in inside.items()]
        rows += [("sign", s, f"{a} {b}", None, None, None, n) for (s, a, b), n in signs.items()]
        for c in (raw, pairs, compounds, inside, signs):
            c.clear()
        return pd.DataFrame(rows, columns=["kind", "a", "b", "doc", "page", "line", "n"])

    for pdf in batches:
        edges = []
        for doc, page, text in zip(pdf["doc"], pdf["page"], pdf["text"], strict=True):
            whole = _without_broken(text)
            run = WORD.findall(whole)
            raw.update(run)
            run = list(map(channel.token, run))
            pairs.update(zip(run, run[1:], strict=False))
            compounds.update(_compounds(text.lower()))
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            if not full:
                continue
            edge = {i + 1 for i in (*full[:2], full[-1])}  # page matter, which stands at the edges, has signs of its own
            signs.update((t, a, b) for t, a, b, line in _lone(text) if line not in edge)
            widest = max(len(lines[i].strip()) for i in full)
            places = {"top": full[0], "top2": full[1] if len(full) > 2 else None, "bottom": full[-1] if len(full) > 1 else None}
            for zone, i in places.items():
                if i is not None:
                    form = shape(lines[i])
                    edges.append((zone, form, _marks(lines[i], form), doc, page, i + 1, _hashed(form)))
            for i in full[2:-1]:
                line = lines[i].strip()
                if len(line) < 0.6 * widest or line.count(" ") < 4:
                    inside[_hashed(shape(line))] += 1
        if edges:
            yield pd.DataFrame(edges, columns=["kind", "a", "b", "doc", "page", "line", "n"])
        if len(pairs) > 300_000:
            yield counted()
    yield counted()


def _hashed(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form) - (1 << 63)


def _marks(line: str, form: str) -> str:
    """What a line looks like: n a number, r a roman number, p more than one word, e authors with et al., l long enough for a title."""
    bare = re.sub(r"[^\w\s]|_", " ", line).strip().lower()
    found = ("n", NUMBER_FORM.fullmatch(form)), ("r", ROMAN.fullmatch(bare)), ("p", not re.fullmatch(r"\w+", bare)), ("e", ET_AL.match(line)), ("l", len(form) >= 12)
    return "".join(mark for mark, yes in found if yes)


def facts(pages: DataFrame) -> DataFrame:
    """All counts and edge lines, written once. ``pages`` is (doc, page, text)."""
    return cut(pages.mapInPandas(_facts, FACTS))


JUDGED = "kind string, word string, n long, doubtful boolean, readings array<string>, counts array<long>, ways array<string>"
ENTRY = "word string, n long, doubtful boolean, readings array<string>, counts array<long>, scores array<double>, doubt double, alone string"


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = ["#" + w if k == "number" else channel.strokes(w) for k, w in zip(pdf["kind"], pdf["a"], strict=True)]
        yield pdf.assign(key=keys)


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges the buckets of rows sorted by key."""
    hits, shown = Counter(), Counter()
    key, words, numbers = None, {}, {}

    def flush() -> list[tuple]:
        entries, h, s = channel.bucket(words, numbers) if words else ({}, {}, {})
        hits.update(h)
        shown.update(s)
        return [("entry", w, e.n, e.doubtful, e.readings, e.counts, e.ways) for w, e in entries.items()]

    for pdf in batches:
        out = []
        for k, kind, w, n in zip(pdf["key"], pdf["kind"], pdf["a"], pdf["n"], strict=True):
            if k != key:
                out += flush()
                key, words, numbers = k, {}, {}
            (words if kind == "word" else numbers)[w] = n
        yield pd.DataFrame(out, columns=["kind", "word", "n", "doubtful", "readings", "counts", "ways"])
    out = flush() + [(kind, str(i), n, None, None, None, None) for kind, c in (("hit", hits), ("shown", shown)) for i, n in c.items()]
    yield pd.DataFrame(out, columns=["kind", "word", "n", "doubtful", "readings", "counts", "ways"])


class Frequent(NamedTuple):
    """What is sent to every task: bounded tables that spare joins, the corpus' size and the kinds of noise signs
    (four a character at most)."""

    entries: dict[str, tuple]
    pairs: dict[tuple[str, str], int]
    total: int
    signs: set[tuple[str, bool, bool]]


class Corpus(NamedTuple):
    """The channel of a corpus: the entries of all words, the counts of pairs and compounds, and the bounded part."""

    lexicon: DataFrame
    pairs: DataFrame
    compounds: DataFrame
    specks: DataFrame  # (sign, l, r): single places of noise signs
    frequent: object  # a broadcast Frequent


def corpus(found: DataFrame) -> Corpus:
    """The noisy channel's tables."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = found.where("kind = 'word'").agg(F.sum("n")).first()[0] or 0
    counted = found.where("kind in ('word', 'number')").groupBy("kind", "a").agg(F.sum("n").alias("n"))
    keyed = counted.mapInPandas(_keyed, "kind string, a string, n long, key string")
    judged = cut(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_judged, JUDGED))
    rows = judged.where("kind in ('hit', 'shown')").groupBy("kind", "word").agg(F.sum("n").alias("n")).collect()  # two rows a confusion
    rate = channel.rates(*({int(r["word"]): r["n"] for r in rows if r["kind"] == kind} for kind in ("hit", "shown")))
    number = judged.where("kind = 'entry' and word = '#'").select("n").first()
    n_numbers = number[0] if number else 0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(total)
        for pdf in batches:
            out = []
            for w, n, d, readings, counts, ways in zip(pdf["word"], pdf["n"], pdf["doubtful"], pdf["readings"], pdf["counts"], pdf["ways"], strict=True):
                e = channel.Entry(n, d, list(readings), [n_numbers if v == "#" else c for v, c in zip(readings, counts, strict=True)], list(ways))
                row = (n, d, e.readings, e.counts, channel.scores(e, rate), channel.doubt(e))
                out.append((w, *row, reader.alone(w, row)))
            yield pd.DataFrame(out, columns=["word", "n", "doubtful", "readings", "counts", "scores", "doubt", "alone"])

    lexicon = cut(judged.where("kind = 'entry'").drop("kind").mapInPandas(score, ENTRY))
    several = cut(found.where("kind in ('pair', 'compound')").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    pairs, compounds = (several.where(F.col("kind") == k).drop("kind") for k in ("pair", "compound"))
    least = max(LEAST, total * SHARE)
    entries = {r["word"]: _entry(r) for r in lexicon.where((F.col("n") >= least) | (F.col("word") == "#")).toPandas().to_dict("records")}
    often = pairs.where(F.col("n") >= least).toPandas()
    kinds, specks = noise_signs(found, pairs, lexicon, total)
    frequent = Frequent(entries, dict(zip(zip(often["a"], often["b"], strict=True), often["n"], strict=True)), total, kinds)
    return Corpus(lexicon, pairs, compounds, specks, spark.sparkContext.broadcast(frequent))


def _entry(r: dict) -> tuple:
    return r["n"], r["doubtful"], list(r["readings"]), list(r["counts"]), list(r["scores"]), r["doubt"]


def noise_signs(found: DataFrame, pairs: DataFrame, lexicon: DataFrame, total: int) -> tuple[set[tuple[str, bool, bool]], DataFrame]:
    """The kinds (sign, number before, number after) of lone signs that are likelier added than printed, and for
    signs that have such a kind the single places (sign, l, r) where that is clear.

    For each place, the odds of the two words following each other are set against those of the sign following
    the one and leading to the other, as seen at all other places. There are no more kinds than four a character.
    """
    at = F.split("b", " ")
    seen = cut(found.where("kind = 'sign'").select(F.col("a").alias("sign"), at[0].alias("l"), at[1].alias("r"), "n").groupBy("sign", "l", "r").agg(F.sum("n").alias("n")))
    per = F.broadcast(seen.groupBy("sign").agg(F.sum("n").alias("n_s")))  # at most one row a character
    left = seen.groupBy("sign", "l").agg(F.sum("n").alias("n_sl"))
    right = seen.groupBy("sign", "r").agg(F.sum("n").alias("n_sr"))
    parted = seen.groupBy("l", "r").agg(F.sum("n").alias("m"))
    plain = pairs.select(F.col("a").alias("l"), F.col("b").alias("r"), F.col("n").alias("n_lr"))
    rows = seen.join(per, "sign").join(left, ["sign", "l"]).join(right, ["sign", "r"]).join(parted, ["l", "r"]).join(plain, ["l", "r"], "left")
    rows = rows.join(lexicon.select(F.col("word").alias("l"), F.col("n").alias("n_l")), "l", "left").join(lexicon.select(F.col("word").alias("r"), F.col("n").alias("n_r")), "r", "left")

    def count(name: str, less: Column | int = 0) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0)).cast("double") - less, F.lit(0.0))

    size = F.lit(float(max(total, 1)))
    share_r, share_s = (count("n_r") + 0.3) / size, F.col("n_s") / size
    without = F.log((count("n_lr", F.col("m")) + 10 * share_r) / (count("n_l") + 10))
    led = F.log((count("n_sl", 1) + 10 * share_s) / ((count("n_l") + 10) * share_s))
    leads = F.log((count("n_sr", 1) + 10 * share_r) / (count("n_s", 1) + 10))
    places = cut(rows.select("sign", "l", "r", "n", (without - led - leads).alias("odds")))
    number = [F.col(c).rlike("^(#|[0-9])").alias(c) for c in ("l", "r")]
    kinds = places.select("sign", *number, "n", (F.col("odds") * F.col("n")).alias("odds")).groupBy("sign", "l", "r").agg(F.sum("n").alias("n"), F.sum("odds").alias("odds"))
    noise = {(r["sign"], r["l"], r["r"]) for r in kinds.where((F.col("n") >= LEAST) & (F.col("odds") > F.greatest(MARGIN * F.col("n"), F.lit(WEIGHT)))).collect()}
    return noise, places.where((F.col("odds") > CLEAR) & F.col("sign").isin(sorted({s for s, _, _ in noise}))).select("sign", "l", "r")


def furniture(found: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, page, line) of page matter. ``titles`` is (doc, title, journal)."""
    every = found.where("kind in ('top', 'top2', 'bottom')").select("kind", F.col("n").alias("shape"), F.col("a").alias("text"), F.col("b").alias("marks"), "doc", "page", "line")
    named = _named(every.where("marks like '%l%' and marks not like '%n%'").select("doc", "shape", "text"), titles)
    edges = cut(every.drop("text").withColumn("side", F.substring("kind", 1, 3)).distinct())
    inside = found.where("kind = 'inside'").groupBy(F.col("a").cast("long").alias("shape")).agg(F.sum("n").alias("n_inside"))
    within = edges.groupBy("doc", "side", "shape").agg(F.countDistinct("page").alias("n_pages"), F.count("*").alias("n_rows"))
    repeats = F.sum((F.col("n_pages") >= 2).cast("long"))
    over = within.groupBy("shape").agg(F.sum("n_rows").alias("n_edge"), F.countDistinct("doc").alias("n_docs"), repeats.alias("n_repeats"))
    sizes = edges.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    known = within.join(over, "shape").join(inside, "shape", "left").join(sizes, "doc").join(named.withColumn("named", F.lit(True)), ["doc", "shape"], "left")
    keeps = F.col("n_edge") >= 4 * F.coalesce("n_inside", F.lit(0))
    # A running head comes back on a good part of its document's pages; a sentence's beginning does so by chance only.
    again = (F.col("n_pages") >= 2) & (F.col("n_pages") >= 0.15 * F.col("pages"))
    common = (F.col("n_docs") >= 3) & (F.col("n_repeats") >= 0.3 * F.col("n_docs"))
    known = known.select("doc", "side", "shape", "pages", again.alias("again"), (keeps & (again | common)).alias("running"), F.coalesce("named", F.lit(False)).alias("named"))
    judged = edges.join(known, ["doc", "side", "shape"])
    roman = (F.col("side") == "bot") & F.col("marks").contains("r")
    number = F.col("again") | (F.col("pages") == 1) | F.col("marks").contains("p") | roman
    other = F.col("running") | F.col("named") | ((F.col("side") == "top") & F.col("marks").contains("e"))
    yes = cut(judged.where((F.col("shape") != _hashed("")) & F.when(F.col("marks").contains("n") | roman, number).otherwise(other)).select("kind", "doc", "page", "line"))
    first = yes.where("kind = 'top'").select("doc", "page")
    return yes.where("kind <> 'top2'").unionByName(yes.where("kind = 'top2'").join(first, ["doc", "page"], "left_semi")).select("doc", "page", "line").distinct()


def _named(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, shape) of the lines that give their document's title or journal, whole or in part."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(d, shape(n)) for d, *names in zip(pdf["doc"], pdf["title"], pdf["journal"], strict=True) for n in names if isinstance(n, str)}
            yield pd.DataFrame([r for r in rows if len(r[1]) >= 10], columns=["doc", "name"])

    names = titles.where("doc is not null").select("doc", "title", "journal").mapInPandas(shapes, "doc long, name string")
    core = F.regexp_replace("text", "^# | #$", "")
    return lines.join(names, "doc").where(F.col("name").startswith(core) | core.startswith(F.col("name"))).select("doc", "shape").distinct()


SEEN = "kind string, doc long, page int, line int, word string, mark string, best string, nexts array<struct<line int, word string>>, lines array<int>"
FOUND = "kind string, doc long, page int, line int, word string, best string"


def _head(lines: list[str], i: int) -> tuple[int, str]:
    """Number and first word of a line."""
    m = FIRST.match(lines[i])
    return i + 1, m.group(1).lower() if m else ""


def _scan(frequent):
    """The second scan: noise signs, broken line ends, the first lines of each page, and runs of words to decode.

    A run is passed on with the words beside it; the halves of broken words end it. The line number of a word that
    may be the rest of a word broken on the page before is negative.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, pairs, _, signs = frequent.value
        plain = {w for w, e in entries.items() if not e[1]}
        chars = {s for s, _, _ in signs}
        speck = re.compile("|".join(map(re.escape, sorted(chars)))) if chars else None
        for pdf in batches:
            out = []
            for doc, page, text in zip(pdf["doc"], pdf["page"], pdf["text"], strict=True):
                lines = text.split("\n")
                full = [i for i, x in enumerate(lines) if x.strip()]
                out.append(("start", doc, page, 0, "", "", "", [_head(lines, i) for i in full[:STARTS]], None))
                seq: list[str] = []
                where: list[int] = []
                halves, after_break = set(), False
                for k, i in enumerate(full):
                    line = lines[i]
                    end = line.rstrip()
                    broken = BROKEN.search(line, max(0, len(end) - 60)) if end[-1] in MARKS else None
                    words = tokens(line)
                    if broken:
                        out.append(("break", doc, page, i + 1, broken.group(1).lower(), broken.group(2), "", [_head(lines, j) for j in full[k + 1 : k + 3]], None))
                    if after_break:
                        halves.add(len(seq))
                    if k < STARTS and words:
                        where.append(-i - 1)
                        where.extend([i + 1] * (len(words) - 1))
                    else:
                        where.extend([i + 1] * len(words))
                    seq.extend(words)
                    after_break = broken is not None
                    if broken:
                        halves.add(len(seq) - 1)
                if speck and speck.search(text):
                    out.extend(("misread" if (t, _number(a), _number(b)) in signs else "sign", doc, page, line, t, a, b, None, None) for t, a, b, line in _lone(text) if t in chars)
                out.extend(_runs(doc, page, seq, where, halves, plain, entries, pairs))
            yield pd.DataFrame(out, columns=["kind", "doc", "page", "line", "word", "mark", "best", "nexts", "lines"])

    return scan


def _number(word: str) -> bool:
    return word[:1] == "#" or "0" <= word[:1] <= "9"


def _runs(doc: int, page: int, seq: list[str], where: list[int], halves: set[int], plain: set[str], entries: dict, pairs: dict) -> Iterator[tuple]:
    """The runs of words that are neither plain nor, if doubtful, in company that the corpus knows well."""
    at = []
    for p in [p for p, w in enumerate(seq) if w not in plain]:
        if p in halves:
            continue
        w = seq[p]
        if w in entries and p and p + 1 < len(seq) and (seq[p - 1], w) in pairs and (w, seq[p + 1]) in pairs and p - 1 not in halves and p + 1 not in halves:
            continue
        at.append(p)
    i = 0
    while i < len(at):
        j = i + 1
        while j < len(at) and at[j] == at[j - 1] + 1:
            j += 1
        first, last = at[i], at[j - 1]
        before = seq[first - 1] if first and first - 1 not in halves else ""
        after = seq[last + 1] if last + 1 < len(seq) and last + 1 not in halves else ""
        yield "run", doc, page, 0, " ".join(seq[first : last + 1]), before, after, None, where[first : last + 1]
        i = j


LOOKED = "array<struct<word:string,n:bigint,doubtful:boolean,readings:array<string>,counts:array<bigint>,scores:array<double>,doubt:double>>"


def _parts(key: str) -> tuple[str, list[str], str]:
    before, run, after = key.split("\n")
    return before, run.split(" "), after


def _local(looked) -> dict[str, tuple]:
    return {r["word"]: _entry(r) for r in looked if r["n"] is not None}


class Both(dict):
    """Entries or pairs at hand, and behind them the frequent ones."""

    def __init__(self, own: dict, frequent: dict):
        super().__init__(own)
        self.frequent = frequent

    def get(self, key, default=None):
        return self[key] if key in self else self.frequent.get(key, default)


def decoded(runs: DataFrame, tables: Corpus) -> DataFrame:
    """(key, best, known): the likeliest words of each distinct run, where they differ from the run or are unknown.

    The entries of the run's words and the counts of the pairs that their readings could form are joined to it.
    """
    frequent = tables.frequent
    keys = runs.select("key").distinct()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = frequent.value.entries
        for pdf in batches:
            rows = []
            for k in pdf["key"]:
                words = {w for w in k.split("\n")[1].split(" ") if w not in entries}
                rows += [(k, w, len(words)) for w in words] or [(k, None, 0)]
            yield pd.DataFrame(rows, columns=["key", "word", "words"])

    asked = cut(keys.mapInPandas(ask, "key string, word string, words int"))
    entry = F.struct("word", "n", "doubtful", "readings", "counts", "scores", "doubt")
    looked = asked.where("words > 0").join(tables.lexicon.drop("alone"), "word", "left")
    one = looked.where("words = 1").select("key", F.array(entry).alias("looked"))
    more = looked.where("words > 1").groupBy("key").agg(F.collect_list(entry).alias("looked"))
    none = asked.where("words = 0").select("key", F.expr(f"cast(array() as {LOOKED})").alias("looked"))
    ready = cut(one.unionByName(more).unionByName(none))

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, pairs, total, _ = frequent.value
        reader = Reader(total)
        for pdf in batches:
            rows = []
            for key, looked in zip(pdf["key"], pdf["looked"], strict=True):
                before, run, after = _parts(key)
                at = Both(_local(looked), entries)
                choices = [[(v, n) for v, _, n in reader.candidates(w, at.get(w))] for w in run]
                if all(len(c) == 1 for c in choices):
                    continue
                ring = [[(before, _count(entries, before))], *choices, [(after, _count(entries, after))]]
                wanted = {(a, b) for x, y in zip(ring, ring[1:], strict=False) if len(x) > 1 or len(y) > 1 for a, n in x if n for b, m in y if m}
                rows += [(key, a, b) for a, b in wanted if (a, b) not in pairs]
            yield pd.DataFrame(rows, columns=["key", "a", "b"])

    met = ready.mapInPandas(need, "key string, a string, b string").join(tables.pairs, ["a", "b"]).groupBy("key").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, pairs, total, _ = frequent.value
        reader = Reader(total)
        for pdf in batches:
            rows = []
            for key, looked, found in zip(pdf["key"], pdf["looked"], pdf["pairs"], strict=True):
                before, run, after = _parts(key)
                at = Both(_local(looked), entries)
                counts = Both({(r["a"], r["b"]): r["n"] for r in found} if found is not None else {}, pairs)
                best = reader.decode((before, _count(entries, before)), run, (after, _count(entries, after)), at, counts)
                known = [bool(e and e[0]) for e in map(at.get, run)]
                if best != run or not all(known):
                    rows.append((key, best, known))
            yield pd.DataFrame(rows, columns=["key", "best", "known"])

    return ready.join(met, "key", "left").mapInPandas(decode, "key string, best array<string>, known array<boolean>")


def _count(entries: dict[str, tuple], word: str) -> int:
    return entries[word][0] if word in entries else 0


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misread and rare words at their places."""
    for pdf in batches:
        out = []
        for doc, page, key, lines, best, known in zip(pdf["doc"], pdf["page"], pdf["key"], pdf["lines"], pdf["best"], pdf["known"], strict=True):
            for w, line, v, sure in zip(_parts(key)[1], lines, best, known, strict=True):
                if w != v:
                    out.append(("misread" if line > 0 else "first", doc, page, abs(line), w, w.translate(DIGITS) if v == "#" else v))
                elif not sure and len(w) >= 5 and line > 0:
                    out.append(("rare", doc, page, line, w, fold(w)))
        yield pd.DataFrame(out, columns=["kind", "doc", "page", "line", "word", "best"])


def _broken(chosen: DataFrame, tables: Corpus) -> DataFrame:
    """Judges each broken line end with the word that follows it; rows as FOUND. The words are looked up once for
    each two halves."""
    halves = ["word", "next_word"]
    two = cut(chosen.select(*halves).distinct())
    roles = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), w.alias("w")) for role, w in (("joined", F.concat(*halves)), ("left", F.col("word")), ("right", F.col("next_word")))])).alias("x")
    entry = tables.lexicon.select(F.col("word").alias("w"), "n", "alone")
    seen = two.select(*halves, roles).select(*halves, "x.role", "x.w").join(entry, "w", "left")
    known = seen.groupBy(*halves).agg(*[F.max(F.when(F.col("role") == r, v)).alias(f"{name}_{r}") for r in ("joined", "left", "right") for name, v in (("n", F.coalesce("n", F.lit(0))), ("alone", F.coalesce("alone", "w")))])
    known = cut(known)
    either = known.select(*halves, F.explode(F.array_distinct(F.array("word", "alone_left"))).alias("a"), F.array_distinct(F.array("next_word", "alone_right")).alias("bs")).withColumn("b", F.explode("bs")).drop("bs")
    pairs = either.join(tables.compounds, ["a", "b"]).groupBy(*halves).agg(F.max("n").alias("as_pair"))
    return chosen.join(known.join(pairs, halves, "left"), halves).mapInPandas(_ends, FOUND)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            left, right, joined, best = r.word, r.next_word, r.word + r.next_word, r.alone_joined
            as_pair = 0 if pd.isna(r.as_pair) else r.as_pair
            if r.mark in "¬\xad":
                hyphen = True
            elif r.n_joined or as_pair:
                hyphen = r.n_joined >= as_pair
            elif best != joined:
                hyphen = True
            else:
                hyphen = not (r.n_left and r.n_right and min(len(left), len(right)) >= 3)
            if hyphen:
                out.append(("hyphen", r.doc, r.page, r.line, joined, best))
                if best != joined:
                    same = next((i for i, (x, y) in enumerate(zip(joined, best, strict=False)) if x != y), min(len(joined), len(best)))
                    tail = next((i for i, (x, y) in enumerate(zip(joined[::-1], best[::-1], strict=False)) if x != y), 0)
                    if same < len(left):
                        out.append(("misread", r.doc, r.page, r.line, joined, best))
                    if len(joined) - tail > len(left) and (same >= len(left) or len(joined) - tail - same > 2):
                        out.append(("misread", r.doc, r.next_page, r.next_line, joined, best))
            else:
                for word, alone, page, line in ((left, r.alone_left, r.page, r.line), (right, r.alone_right, r.next_page, r.next_line)):
                    if alone != word:
                        out.append(("misread", r.doc, page, line, word, alone))
            out.append(("taken", r.doc, r.next_page, r.next_line, right, ""))
        yield pd.DataFrame(out, columns=["kind", "doc", "page", "line", "word", "best"])


def defects(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, page, line, defect, word, best): every damaged line; ``word`` and ``best`` tell what is repaired.

    ``pages`` is (document_id, page_number, text), ``documents`` (doc_id, title, journal).
    """
    rows = _rows(pages)
    found = facts(rows)
    tables = corpus(found)
    matter = cut(furniture(found, documents.select(F.col("doc_id").alias("doc"), "title", "journal")))
    seen = cut(rows.mapInPandas(_scan(tables.frequent), SEEN))
    # What follows a broken end: the next body line of the page, else the first of the next page.
    place = ["doc", "page", "line", "word", "mark"]
    breaks = seen.where("kind = 'break'").select(*place, "nexts").join(matter, ["doc", "page", "line"], "left_anti")
    body = matter.select("doc", F.col("page").alias("next_page"), F.col("line").alias("next_line"))
    own = breaks.select(*place, F.posexplode("nexts").alias("at", "next")).select(*place, "at", F.col("page").alias("next_page"), F.col("next.line").alias("next_line"), F.col("next.word").alias("next_word"))
    starts = seen.where("kind = 'start'").select("doc", F.col("page").alias("next_page"), F.posexplode("nexts").alias("at", "next")).select("doc", "next_page", "at", F.col("next.line").alias("next_line"), F.col("next.word").alias("next_word"))
    opening = starts.join(body, ["doc", "next_page", "next_line"], "left_anti").groupBy("doc", "next_page").agg(F.min_by(F.struct("next_line", "next_word"), "at").alias("open"))
    # Only a break with fewer than two lines after it, or the foot of the page among them, can go on overleaf.
    later = breaks.where(F.size("nexts") < 2).select(*place).withColumn("next_page", F.col("page") + 1).join(opening, ["doc", "next_page"])
    later = later.select(*place, F.lit(9).alias("at"), "next_page", F.col("open.next_line").alias("next_line"), F.col("open.next_word").alias("next_word"))
    ahead = own.join(body, ["doc", "next_page", "next_line"], "left_anti").select(*later.columns).unionByName(later)
    # A page written twice gives its breaks twice; the group keeps one of each.
    chosen = ahead.groupBy("doc", "page", "line").agg(F.min_by(F.struct("word", "mark", "next_page", "next_line", "next_word"), "at").alias("c")).select("doc", "page", "line", "c.*").where("next_word <> ''")
    chosen = cut(chosen)
    ends = cut(_broken(chosen, tables))
    taken = ends.where("kind = 'taken'").select("doc", "page", "line")

    runs = seen.where("kind = 'run'").select("doc", "page", F.concat_ws("\n", "mark", "word", "best").alias("key"), "lines")
    told = runs.join(decoded(runs, tables), "key").mapInPandas(_told, FOUND)
    signs = seen.where("kind = 'sign'").select("doc", "page", "line", F.col("word").alias("sign"), F.col("mark").alias("l"), F.col("best").alias("r"))
    signs = signs.join(tables.specks, ["sign", "l", "r"], "left_semi").select(F.lit("misread").alias("kind"), "doc", "page", "line", F.col("sign").alias("word"), F.lit("").alias("best"))
    specks = seen.where("kind = 'misread'").select("kind", "doc", "page", "line", "word", F.lit("").alias("best"))
    told = cut(told.unionByName(specks).unionByName(signs).join(matter, ["doc", "page", "line"], "left_anti"))
    plain = told.where("kind = 'misread'").drop("kind")
    first = told.where("kind = 'first'").drop("kind").join(taken, ["doc", "page", "line"], "left_anti")
    misread = plain.unionByName(first).unionByName(ends.where("kind = 'misread'").drop("kind")).unionByName(_names(told, documents))
    return (
        misread.withColumn("defect", F.lit("misread"))
        .unionByName(ends.where("kind = 'hyphen'").drop("kind").withColumn("defect", F.lit("hyphen")))
        .unionByName(matter.select("doc", "page", "line", F.lit("").alias("word"), F.lit("").alias("best"), F.lit("furniture").alias("defect")))
        .distinct()
    )


def _rows(pages: DataFrame) -> DataFrame:
    return spread(pages.where("text is not null and document_id is not null").select(F.col("document_id").cast("long").alias("doc"), F.coalesce(F.col("page_number"), F.lit(0)).cast("int").alias("page"), "text"))


def _names(seen: DataFrame, documents: DataFrame) -> DataFrame:
    """Misread names: a rare word whose folded form stands at least twice as often in another spelling in
    its document, or once in the document's title."""
    rare = seen.where("kind = 'rare'").select("doc", "page", "line", "word", F.col("best").alias("form"))
    counted = rare.groupBy("doc", "form", "word").agg(F.count("*").alias("n"))

    def title_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, fold(w), w, 3) for d, t in zip(pdf["doc"], pdf["title"], strict=True) for w in set(tokens(t)) if len(w) >= 5]
            yield pd.DataFrame(rows, columns=["doc", "form", "word", "n"])

    named = documents.where("title is not null").select(F.col("doc_id").alias("doc"), "title").mapInPandas(title_words, "doc long, form string, word string, n long")
    forms = counted.select("doc", "form").distinct()
    weighed = counted.unionByName(named.join(forms, ["doc", "form"], "left_semi")).groupBy("doc", "form", "word").agg(F.sum("n").alias("n"))
    best = weighed.groupBy("doc", "form").agg(F.max_by(F.struct("word", "n"), F.struct("n", "word")).alias("top"))
    wrong = weighed.join(best, ["doc", "form"]).where("word <> top.word and top.n >= 2 * n").select("doc", "form", "word", F.col("top.word").alias("best"))
    return rare.join(wrong, ["doc", "form", "word"]).select("doc", "page", "line", "word", "best")


def _cased(seen: str, word: str) -> str:
    """``word`` in capitals or with a capital, as the word it is put for."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if seen[:1].isupper() else word


def paragraphs(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, page, text): each page's running paragraphs, page matter gone, words joined and repaired.

    A word broken over two pages is given whole to the page where it begins.
    """
    found = cut(defects(pages, documents))
    per = found.groupBy("doc", "page").agg(F.collect_list(F.struct("line", "defect", "word", "best")).alias("marks"))
    over = found.where("defect = 'hyphen'").select("doc", "page", F.struct("line", "word", "best").alias("b"))
    last = over.groupBy("doc", "page").agg(F.max("b").alias("b")).select("doc", (F.col("page") + 1).alias("page"), F.col("b.word").alias("carried"), F.col("b.line").alias("carried_line"), F.col("page").alias("from_page"))
    rows = _rows(pages).groupBy("doc", "page").agg(F.min("text").alias("text"))
    body = rows.join(per, ["doc", "page"], "left").join(last, ["doc", "page"], "left")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                marks = list(r.marks) if r.marks is not None else []
                matter = {m["line"] for m in marks if m["defect"] == "furniture"}
                breaks = {m["line"]: m for m in marks if m["defect"] == "hyphen"}
                fixes: dict[int, dict[str, str]] = {}
                for m in marks:
                    if m["defect"] == "misread":
                        fixes.setdefault(m["line"], {})[m["word"]] = m["best"]
                blocks, block, joined = [], [], r.carried if isinstance(r.carried, str) else ""
                for number, line in enumerate(r.text.split("\n"), 1):
                    if number in matter:
                        continue
                    if not line.strip():
                        if block:
                            blocks.append(" ".join(block))
                            block = []
                        continue
                    for sign in [w for w, v in fixes.get(number, {}).items() if not v]:
                        line = re.sub(rf"(?<!\S){re.escape(sign)}(?!\S)", "", line)
                    line = re.sub(r"\s+", " ", line).strip()
                    head = FIRST.match(line)
                    if joined and head and joined.endswith(head.group(1).lower()) and len(joined) > len(head.group(1)):
                        line = line[head.end() :].lstrip()
                        if block and line[:1] in ".,;:)":
                            block[-1] += line[0]
                            line = line[1:].lstrip()
                    joined = ""
                    for seen_word, best in fixes.get(number, {}).items():
                        if best:
                            line = re.sub(rf"(?i)(?<![^\W_]){re.escape(seen_word)}(?![^\W_])", lambda m, b=best: _cased(m.group(0), b), line)
                    if number in breaks:
                        b = breaks[number]
                        stem = BROKEN.sub("", line)
                        tail = BROKEN.search(line)
                        word = b["best"] or b["word"]
                        line = stem + (_cased(tail.group(1), word) if tail else word)
                        joined = b["word"]
                    if line and block and re.search(r"[^\W_][-‐]$", block[-1]):
                        block[-1] += line  # a compound parted at its own hyphen
                    elif line:
                        block.append(line)
                if block:
                    blocks.append(" ".join(block))
                out.append((r.doc, r.page, "\n\n".join(blocks)))
            yield pd.DataFrame(out, columns=["doc", "page", "text"])

    return body.mapInPandas(rebuild, "doc long, page int, text string")
