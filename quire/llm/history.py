"""Problem 3: checking new batches for duplicates against everything already accepted.

Method: an incremental inverted index of words and their slips. The index is a bucketed table in the shared folder,
partitioned by key; a batch appends its own postings and probes them against the table, which is read once and not
shuffled again. Candidates are verified by their whole titles. Digests and DOIs are index keys of the same kind,
met by equality.

What counts as common is fixed when the index is opened, from the titles of the accepted history: a word in
at least ``COMMON`` of the titles (never fewer than ``COMMON_LEAST``). Typing slips of common words are
repaired first, over their deletion neighbourhoods, so a slip does not pass for a rare word.

Titles are compared as classes of equal content words, so copies, other orders and other function words need no
comparison. Two further classes can be the same only if they have equally many content words and the same numbers,
and if every other word of one has an equal word or a slip of it in the other. So a class is posted under all
its words, and it is enough that a new class asks for one word of its own: the partner's word is met under a form with
letters left out, or as a neighbour among the common words. Classes whose common words cannot be slips of one another are no
candidates. All pairs that ``same_title`` accepts are met in this way, however
many of their words differ.

A class asks for its rarest word. If more than ``LONG`` classes are posted there, it asks for that of its words that
fewest are posted under; if those are too many too, they are posted again below that word under all their words, and
the class asks for a second word of its own there, and so on. Nothing is left out: a list is split until it is short or the class has no words left.

Everything is kept below ``path``: an index opened there again, in another session, goes on where the last finished
batch left it. A batch that failed half-way leaves nothing behind that counts.

Work is kept by title class: copies of a title cost one posting, and a class links to another
once, however many records have it. Same work by title needs at least one record without DOI, or equal
DOIs; a class without such a record links by DOI alone.

Defined results: blank titles, and titles of fewer than 24 characters once normalised, prove nothing; blank
or placeholder DOIs and digests of empty files prove nothing; repeated rows count once; a record without any
key is a work of its own; an empty batch changes nothing; a batch that is in the index is refused; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.confusables import skeleton
from quire.llm.edits import deletions, distance
from quire.operators.components import components
from quire.session import cut, scratch_dir

COMMON = 0.001
COMMON_LEAST = 10
LONG = 1000
HEAD = 6
LEAST_TITLE = 24
EMPTY_FILE = hashlib.sha256(b"").hexdigest()
# Articles, prepositions and conjunctions of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "a an the of in on at to for from with by and or as der die das den dem des ein eine einer eines einem im in am an auf aus bei von vom zu zum zur mit und oder fur "
    "le la les l un une des du de d en et ou au aux a dans sur pour par chez el los las un una del al y o e u con por para sobre entre".split()
)
ROMAN = re.compile(r"[ivx]+")


def doi_key(col: Column) -> Column:
    """A DOI in one notation; null where there is none or it is a placeholder (registrant below 1000)."""
    plain = F.regexp_replace(F.lower(col), r"(?U)[\s\p{Cf}]+", "")
    found = F.regexp_replace(F.regexp_extract(F.replace(plain, F.lit("%2f"), F.lit("/")), r"10\.[0-9]{4,9}(?:\.[0-9]+)*/\S+", 0), r"[.,;:)\]}>\"']+$", "")
    return F.when(found.rlike(r"^10\.0*[1-9][0-9]{3,}[./]") & ~found.rlike(r"/$"), found)


def digest_key(col: Column) -> Column:
    """A SHA-256 digest in one notation; null where there is none or the file is empty."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)[\s\p{Cf}]+", ""), r"^sha-?256[:=-]?|[:-]", "")
    return F.when(plain.rlike("^[0-9a-f]{64}$") & (plain != EMPTY_FILE) & ~plain.rlike(r"^(.)\1*$"), plain)


def normalise(title: str | None) -> str:
    """Lower-case ASCII words of a title, parted by one blank."""
    if not title:
        return ""
    folded = unicodedata.normalize("NFKD", skeleton(title).replace("ß", "ss").casefold())
    return " ".join(re.findall(r"[a-z0-9]+", "".join(c for c in folded if not unicodedata.combining(c))))


def fixed(token: str) -> bool:
    """Numbers, roman numerals and single letters name a part; they are never taken for slips."""
    return any(c.isdigit() for c in token) or len(token) == 1 or ROMAN.fullmatch(token) is not None


def reach(word: str) -> int:
    """How many letters may have to be left out of a word so that it meets its slips (see ``slip``)."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def slip(a: str, b: str) -> bool:
    """Whether two different words are slips of each other: one edit, or two if one has six letters or more."""
    longer = max(len(a), len(b))  # either may come first
    return longer >= 4 and distance(a, b) <= (2 if longer >= 6 else 1)


class Speller:
    """Repairs slips of common words: the nearest common word within one edit, or two in words of seven
    letters or more; the more frequent wins a tie, then the smaller."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.near: dict[str, list[str]] = {}
        for word in common:
            if len(word) >= 3 and not fixed(word):
                for form in deletions(word, reach(word)):
                    self.near.setdefault(form, []).append(word)
        self.memo: dict[str, str] = {}
        self.met: dict[str, tuple[str, ...]] = {}
        self.families: dict[str, str] = {}
        self.keys: dict[str, tuple[list[int], list[int]]] = {}  # of common words

    def beside(self, token: str) -> tuple[str, ...]:
        """The common words that share a form with ``token``."""
        if token not in self.met:
            self.met[token] = tuple({w for form in deletions(token, reach(token)) for w in self.near.get(form, ())})
        return self.met[token]

    def repair(self, token: str) -> str:
        if token in self.common or len(token) < 3 or fixed(token):
            return token
        if token not in self.memo:
            most = 2 if len(token) >= 7 else 1
            ranked = sorted((distance(token, w), -self.common[w], w) for w in self.beside(token) if len(w) >= 4)
            self.memo[token] = ranked[0][2] if ranked and ranked[0][0] <= most else token
        return self.memo[token]

    def alike(self, word: str) -> list[str]:
        """The common words that ``word`` is a slip of."""
        return sorted(w for w in self.beside(word) if w != word and w not in FUNCTION_WORDS and slip(word, w))

    def family(self, word: str) -> str:
        """The smallest of all common words that a common one leads to over slips."""
        if word not in self.families:
            members = [word]
            for member in members:
                members.extend(w for w in self.alike(member) if w not in members)
            self.families.update(dict.fromkeys(members, min(members)))
        return self.families[word]

    def base_of(self, content: list[str]) -> int:
        """The families of a title's common words: equal in titles that are the same. 0 (any) if a rare word may stand for a common one."""
        probes = [w for w in content if not fixed(w)]
        if any(w not in self.common and self.alike(w) for w in probes):
            return 0
        return xxhash.xxh32_intdigest(" ".join(sorted(self.family(w) for w in probes if w in self.common))) >> 1 or 1

    def word_keys(self, word: str) -> tuple[list[int], list[int]]:
        """The keys a word is posted under and those it asks for. What a word asks for is met by every word that is
        equal to it or a slip of it: rare words by their forms, common words by themselves, a rare and a common one by the latter.
        Forms are those of a word's first ``HEAD`` letters: what is left out of two words is left out of their heads, or pushed over the heads' ends."""
        if word in self.keys:
            return self.keys[word]
        near = self.alike(word)
        by_word = [_hashed(f"= {w}") for w in near]
        if word in self.common:
            own = [_hashed(f"= {word}")]
            self.keys[word] = own, [*own, *by_word, _hashed(f"~ {word}")]
            return self.keys[word]
        forms = [_hashed(f"- {form}") for form in sorted(deletions(word[:HEAD], reach(word)))]
        return forms + [_hashed(f"~ {w}") for w in near], forms + by_word


def _hashed(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def content_of(words: list[str]) -> list[str]:
    return sorted(w for w in words if w not in FUNCTION_WORDS)


def frame_of(content: list[str]) -> int:
    """What two titles that are the same have in common for certain: the number of content words, and the fixed ones."""
    return _hashed(" ".join([str(len(content)), *(w for w in content if fixed(w))]))


def probes_of(content: list[str], common: dict[str, int]) -> list[str]:
    """The words of a title that may be slips, the rarest first."""
    return sorted({w for w in content if not fixed(w)}, key=lambda w: (common.get(w, 0), -len(w), w))


def same_title(a: str, b: str) -> bool:
    """Whether two repaired titles differ by slips only: every word of one stands in the other, but for
    function words and for words that can be paired off as slips of each other; order does not matter."""
    x, y = Counter(a.split()), Counter(b.split())
    only_a = [w for w in (x - y).elements() if w not in FUNCTION_WORDS]
    only_b = [w for w in (y - x).elements() if w not in FUNCTION_WORDS]
    if len(only_a) != len(only_b) or any(fixed(w) for w in only_a + only_b):
        return False
    slips = []
    for w in only_a:
        slips.append([i for i, v in enumerate(only_b) if slip(w, v)])
        if not slips[-1]:
            return False
    return _paired_off(slips)


def _paired_off(partners: list[list[int]]) -> bool:
    """Whether everyone can have a partner of their own: who finds all theirs taken takes one over if its holder finds another."""
    holder: dict[int, int] = {}
    for one in range(len(partners)):
        asked_by: dict[int, int] = {}
        queue, free = [one], None
        for at in queue:
            for p in partners[at]:
                if p in asked_by:
                    continue
                asked_by[p] = at
                if p not in holder:
                    free = p
                    break
                queue.append(holder[p])
            if free is not None:
                break
        if free is None:
            return False
        had = {at: p for p, at in holder.items()}
        while free is not None:
            at = asked_by[free]
            holder[free] = at
            free = had.get(at)
    return True


ROWS_A_BUCKET = 200_000  # of the accepted history, to a bucket of the index
POSTING = "key bigint, title_id binary, base int, attempt string"


class HistoryIndex:
    """The keys of all accepted batches, in tables below ``path``; batches are added one after another, in any
    number of sessions, one at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_dir(spark)
        done = self._table("done")
        rows = sorted((r["batch"], r["attempt"], r["buckets"]) for r in done.collect()) if done else []  # a row a batch
        self.batches = [r[0] for r in rows]
        self.attempts = [r[1] for r in rows]
        self.buckets = rows[0][2] if rows else buckets
        common = self._table("common")
        self.common = {r["word"]: r["count"] for r in common.collect()} if rows and common else None  # see _common_words
        self.table = f"quire_postings_{uuid.uuid4().hex}"
        if rows:
            spark.sql(f"CREATE TABLE {self.table} ({POSTING}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'")

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return None

    def _parts(self, name: str, attempts: list[str] | None = None) -> DataFrame:
        """The rows of a table that finished batches wrote."""
        return self.spark.read.parquet(*[f"{self.path}/{name}/{a}" for a in attempts or self.attempts])

    def open(self, history: DataFrame) -> None:
        """Fix the common words from the accepted history."""
        self.common = _common_words(history, COMMON_LEAST)
        rows = list(self.common.items())
        self.spark.createDataFrame(rows, "word string, count long").write.mode("overwrite").parquet(f"{self.path}/common")

    def add(self, batch: int, documents: DataFrame, files: DataFrame) -> None:
        """Append one batch: (doc_id, title, normalized_title, doi) and its files (document_id, sha256)."""
        if batch in self.batches:
            raise ValueError(f"batch {batch} is in the index already")
        if self.common is None:
            self.open(documents)
        attempt = uuid.uuid4().hex
        self._prepared(documents).write.parquet(f"{self.path}/rows/{attempt}")
        rows = self._parts("rows", [attempt])
        digests = files.select(F.col("document_id").alias("doc_id"), digest_key(F.col("sha256")).alias("digest")).where("digest is not null and doc_id is not null")
        digests.distinct().write.parquet(f"{self.path}/digests/{attempt}")
        # Records of a class are alike in all their keys.
        mine = rows.where("title_id is not null").groupBy("title_id").agg(F.min(F.struct("frame", "base", "posts")).alias("s"))
        posted = mine.select(F.col("s.frame").alias("frame"), F.explode("s.posts").alias("post"), "title_id", "s.base").select(F.xxhash64("frame", "post").alias("key"), "title_id", "base", F.lit(attempt).alias("attempt"))
        if not self.buckets:
            self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_BUCKET))
        writer = posted.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet")
        writer.option("path", f"{self.path}/postings").mode("append").saveAsTable(self.table)
        self._linked(attempt).write.parquet(f"{self.path}/links/{attempt}")
        self.spark.createDataFrame([(batch, attempt, self.buckets)], "batch int, attempt string, buckets int").write.mode("append").parquet(f"{self.path}/done")
        self.batches.append(batch)
        self.attempts.append(attempt)

    def _linked(self, attempt: str) -> DataFrame:
        """(a, b): the title classes of this batch that are the same as a class of any batch so far."""
        index = self.spark.table(self.table).where(F.col("attempt").isin([*self.attempts, attempt]))
        index = index.select("key", F.col("title_id").alias("b"), F.col("base").alias("base_b"), (F.col("attempt") == attempt).alias("new_b"))
        mine = self._parts("rows", [attempt]).where("title_id is not null").groupBy(F.col("title_id").alias("a")).agg(F.min(F.struct("frame", "base", "asks")).alias("s"))
        asks = mine.select("a", "s.base", F.col("s.frame").alias("frame"), F.explode("s.asks").alias("ask")).select("a", "base", F.xxhash64("frame", "ask").alias("key"))
        long = cut(index.groupBy("key").count().where(F.col("count") > LONG).select("key"))
        deep = cut(asks.join(long, "key").select("a").distinct())
        if deep.isEmpty():
            pairs = cut(_pairs(asks.join(index, "key")))
        else:
            pairs = cut(_pairs(asks.join(deep, "a", "left_anti").join(index, "key"))).unionByName(self._split(deep, index, attempt)).distinct()
        sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("title_id"))
        both = sides.join(self._classes([*self.attempts, attempt], sides.select("title_id"), "words"), "title_id").groupBy("a", "b").agg(F.min_by("words", "title_id").alias("words_a"), F.max_by("words", "title_id").alias("words_b"))
        return both.mapInPandas(_verified, "a binary, b binary")

    def _classes(self, attempts: list[str], wanted: DataFrame, *columns: str) -> DataFrame:
        """(title_id, columns): one row for each title class wanted."""
        rows = self._parts("rows", attempts).select("title_id", F.struct(*columns).alias("s")).join(wanted.distinct(), "title_id", "left_semi")
        return rows.groupBy("title_id").agg(F.min("s").alias("s")).select("title_id", "s.*")

    def _split(self, deep: DataFrame, index: DataFrame, attempt: str) -> DataFrame:
        """(a, b): candidates of the new classes ``deep``, whose rarest words stand in long lists.

        Each turn a class goes on with that of its words that fewest are posted under. It meets these if they are few;
        otherwise they and all classes that chose this word there move to a list of their own (``at``), to be told apart by their other words.
        """
        common = self.common

        def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            speller = Speller(common)
            for pdf in batches:
                rows = [(a, frame, base, word, speller.word_keys(word)[1]) for a, frame, base, words in zip(pdf["a"], pdf["frame"], pdf["base"], pdf["words"], strict=True) for word in probes_of(words.split(), common)]
                yield pd.DataFrame(rows, columns=["a", "frame", "base", "word", "asks"])

        classes = self._classes([attempt], deep.select(F.col("a").alias("title_id")), "frame", "base", "words").withColumnRenamed("title_id", "a")
        spoken = cut(classes.mapInPandas(spelled, "a binary, frame long, base int, word string, asks array<long>"))
        left = spoken.select("a", "base", F.col("frame").alias("at"), "word", "asks")
        posted = index
        found: DataFrame | None = None
        while True:
            asks = cut(left.select("a", "base", "at", "word", F.explode("asks").alias("ask")).select("a", "base", "at", "word", F.xxhash64("at", "ask").alias("key")))
            met = cut(posted.join(asks.select("key").distinct(), "key", "left_semi"))
            costs = asks.join(met.groupBy("key").count(), "key").groupBy("a", "base", "at", "word").agg(F.sum("count").alias("cost"))
            best = cut(costs.groupBy("a", "base", "at").agg(F.min_by(F.struct("word", "cost"), F.struct("cost", "word")).alias("s")).select("a", "base", "at", "s.word", "s.cost"))
            chosen = asks.join(best.drop("base"), ["a", "at", "word"])
            few = cut(_pairs(chosen.where(F.col("cost") <= LONG).join(met, "key")))
            found = few if found is None else found.unionByName(few)
            many = best.where(F.col("cost") > LONG).select("a", "base", "at", "word", F.xxhash64("at", "word").alias("next"))
            if many.isEmpty():
                return found
            lists = chosen.where(F.col("cost") > LONG).select(F.xxhash64("at", "word").alias("at"), "key").distinct().join(met, "key").groupBy("at", "b", "base_b").agg(F.min("new_b").alias("new_b"))
            lists = cut(lists)
            rest = left.join(many.withColumnRenamed("word", "used").drop("base"), ["a", "at"])
            left = cut(rest.where("word <> used").select("a", "base", F.col("next").alias("at"), "word", "asks"))
            # Classes without a word left meet all of their list: it holds hardly any but the same.
            done = many.select("a", "base", F.col("next").alias("at")).join(left.select("a").distinct(), "a", "left_anti")
            found = found.unionByName(cut(_pairs(done.join(lists, "at"))))
            if left.isEmpty():
                return found
            lists = lists.join(left.select("at").distinct(), "at", "left_semi")
            posts = self._classes([*self.attempts, attempt], lists.select(F.col("b").alias("title_id")), "posts").withColumnRenamed("title_id", "b")
            posted = lists.join(posts, "b").select("at", F.explode("posts").alias("post"), "b", "base_b", "new_b").select(F.xxhash64("at", "post").alias("key"), "b", "base_b", "new_b")

    def _prepared(self, documents: DataFrame) -> DataFrame:
        common = self.common

        def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            speller = Speller(common)
            for pdf in batches:
                rows = []
                for doc_id, doi, title in zip(pdf["doc_id"], pdf["doi"], map(normalise, pdf["title"]), strict=True):
                    if len(title) < LEAST_TITLE:
                        rows.append((doc_id, doi, None, None, 0, 0, None, None))  # no null: pandas would turn the frames to floats
                        continue
                    content = content_of([speller.repair(w) for w in title.split()])
                    words, probes = " ".join(content), probes_of(content, common)
                    posts = sorted({k for w in probes for k in speller.word_keys(w)[0]})
                    asks = speller.word_keys(probes[0])[1] if probes else []
                    rows.append((doc_id, doi, hashlib.md5(words.encode()).digest(), words, frame_of(content), speller.base_of(content), posts, asks))
                yield pd.DataFrame(rows, columns=["doc_id", "doi", "title_id", "words", "frame", "base", "posts", "asks"])

        title = F.when(F.col("title").rlike(r"(?U)\S"), F.col("title")).otherwise(F.col("normalized_title"))
        rows = documents.where("doc_id is not null").select("doc_id", doi_key(F.col("doi")).alias("doi"), title.alias("title"))
        return rows.mapInPandas(prepare, "doc_id long, doi string, title_id binary, words string, frame long, base int, posts array<long>, asks array<long>")

    def works(self) -> DataFrame:
        """(doc_id, work): for every record that shares its work with another, the smallest id of the work.

        The edges are stars, one edge a record and key; only keys and ids are read, no texts.
        """
        rows, digests = self._parts("rows"), self._parts("digests")
        keys = rows.where("doi is not null").select("doc_id", F.concat(F.lit("doi "), "doi").alias("key")).unionByName(digests.select("doc_id", F.concat(F.lit("sha "), "digest").alias("key")))
        exact = keys.groupBy("key").agg(F.min("doc_id").alias("hub"))
        edges = keys.join(exact, "key").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
        titled = rows.where("title_id is not null").select("doc_id", "title_id", F.coalesce("doi", F.lit("-")).alias("doi"))
        # One row per class and DOI ('-' for none), then per class its first record without DOI.
        forms = cut(titled.groupBy("title_id", "doi").agg(F.min("doc_id").alias("first")))
        free = forms.where("doi = '-'").select("title_id", F.col("first").alias("hub"))
        inside = titled.join(free, "title_id").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
        pairs = self._parts("links").distinct()
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = both.join(free, both["a"] == free["title_id"]).select("hub", F.col("b").alias("title_id")).join(forms, "title_id").select(F.col("hub").alias("a"), F.col("first").alias("b"))
        found = components(edges.unionByName(inside).unionByName(across))
        return found.select(F.col("node").alias("doc_id"), F.col("component").alias("work"))


def _pairs(met: DataFrame) -> DataFrame:
    """The pairs of a new class and another, each once; an old class posted again by this batch meets itself and is skipped."""
    alike = (F.col("base") == F.col("base_b")) | (F.col("base") == 0) | (F.col("base_b") == 0)
    return met.where((F.col("a") != F.col("b")) & (~F.col("new_b") | (F.col("a") < F.col("b"))) & alike).select("a", "b").distinct()


def _normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "title": [normalise(t) for t in pdf["title"]]})


def _common_words(documents: DataFrame, least: int) -> dict[str, int]:
    """Words of at least ``least`` distinct titles and of ``COMMON`` of them: at most (words per title / COMMON)."""
    titles = documents.select("doc_id", "title").mapInPandas(_normalised, "doc_id long, title string").select("title").distinct()
    titles = cut(titles.where(F.length("title") >= LEAST_TITLE))
    counted = titles.select(F.explode(F.array_distinct(F.split("title", " "))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.where(F.col("count") >= max(least, int(titles.count() * COMMON))).collect()}


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        same = [same_title(x, y) for x, y in zip(pdf["words_a"], pdf["words_b"], strict=True)]
        yield pdf.loc[same, ["a", "b"]]


def add_all(documents: DataFrame, files: DataFrame, index: HistoryIndex | None = None) -> HistoryIndex:
    """Add the batches of a table one after another, in order; a null batch counts as history (0)."""
    spark = documents.sparkSession
    index = index or HistoryIndex(spark)
    docs = documents.select("doc_id", "title", "normalized_title", "doi", F.coalesce(F.col("import_batch"), F.lit(0)).alias("batch"))
    numbers = sorted(r["batch"] for r in docs.select("batch").distinct().collect())  # a handful
    if numbers and index.common is None:
        index.open(docs.where(F.col("batch") == numbers[0]).select("doc_id", "title"))
    located = cut(files.select("document_id", "sha256").join(docs.select(F.col("doc_id").alias("document_id"), "batch"), "document_id"))
    for number in numbers:
        index.add(number, docs.where(F.col("batch") == number), located.where(F.col("batch") == number))
    return index


def newcomers(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(first_id, doc_id, batch): every record of a later batch whose work has a smaller id, with the smallest."""
    index = add_all(documents, files)
    if not index.batches:
        return documents.select(F.col("doc_id").alias("first_id"), "doc_id", F.col("import_batch").alias("batch")).limit(0)
    later = documents.where("import_batch >= 1").select("doc_id", F.col("import_batch").alias("batch")).distinct()
    return index.works().where("work < doc_id").join(later, "doc_id").select(F.col("work").alias("first_id"), "doc_id", "batch")
