"""Problem 1: variant spellings of names typed by people.

Method: a symmetric-delete index over the distinct name tokens finds tokens one edit apart (each token is
posted under itself and every form with one character left out; tokens that share a form are compared);
a rare token stands for its more frequent neighbour. Spellings that then agree in family name and in given
name, nickname or initial are put together, and every member is confirmed against the fullest spelling of
its person by an optimal assignment of tokens that permits initials, nicknames and abbreviations.

Which of two tokens is the family name is learned from the corpus: forms that leave no doubt (before a
comma, in capitals, beside initials) vote for the role of each token, the votes decide the other forms.

Everything is regrouped by keys of one family name and one initial or one given name; what is counted there is
reduced before the shuffle, so a frequent family name is no unbounded group, and no pairs exist before the
answer is written.

Defined results: null and blank author lists have no names; ``et al.`` is nobody; a spelling that fits two
people (initials shared by several of a family, a given name with several middle initials) is joined to
neither; repeated names count once; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.confusables import skeleton
from quire.llm.edits import deletions, distance
from quire.session import cut

# Fixed values.
TITLES = frozenset("dr prof professor mr mrs ms md phd mph msc bsc dphil frcp rn jr sr med habil mba".split())
PARTICLES = frozenset("de la las los le del della der den des di da dos du van von vom zu zur ter ten te el al bin ibn abu mac mc st san".split())
BODY_WORDS = frozenset(
    "group grp study consortium consort investigators invest collaborative collab collaboration network netw trial registry party force committee "
    "society team initiative alliance task working research outcomes association institute centre center".split()
)
IDLE_WORDS = frozenset("on behalf of the for and in a an".split())
NICKNAMES = {
    formal: tuple(short.split())
    for formal, short in {
        "abigail": "abby gail", "alexander": "alex sasha sandy xander", "anastasia": "nastya stacy stasia ana", "anthony": "tony ant", "archibald": "archie",
        "benjamin": "ben benny benji", "cassandra": "cassie sandra cass", "christopher": "chris kit topher", "daniel": "dan danny", "delphine": "del", "dmitri": "dima mitya",
        "dolores": "lola lolita", "ekaterina": "katya katia", "elizabeth": "liz beth betty eliza lizzie libby", "francisco": "paco pancho frank", "frederick": "fred freddy freddie", "friedrich": "fritz fredi",
        "gabriel": "gabe", "giovanni": "gianni nanni", "giuseppe": "beppe peppe pino", "guadalupe": "lupe lupita", "gwendolyn": "gwen wendy", "ignacio": "nacho iggy", "jennifer": "jenny jen",
        "johannes": "hans jan johan", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "josie jo", "katherine": "kate kathy katie kat kay", "leonard": "leo len lenny", "margaret": "peggy maggie meg greta marge",
        "matthew": "matt matty", "michael": "mike mick mickey", "mikhail": "misha", "nadezhda": "nadia nadya", "nicholas": "nick nicky", "patricia": "pat trish patty tricia", "penelope": "penny nell",
        "quentin": "quin", "rebecca": "becky becca", "robert": "bob rob bobby robbie bert", "rosalind": "rosie roz ros", "samuel": "sam sammy", "susannah": "sue susie suzy anna", "theodora": "dora thea theo", "thomas": "tom tommy",
        "umberto": "berto", "valeria": "val lera", "victoria": "vicky tori vic", "vladimir": "volodya vova vlad", "wilhelmina": "mina willa minnie", "william": "bill will billy liam willy", "wolfgang": "wolf",
        "yevgenia": "zhenya", "zbigniew": "zbyszek", "jaromir": "jarek", "laszlo": "laci", "ulrike": "uli ulli rike", "birgit": "gitte biggi",
        "edward": "ed ted ned eddie", "richard": "dick rick rich", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck", "henry": "harry hank", "andrew": "andy drew", "catherine": "cathy cat",
    }.items()
}
FORMAL = {short: formal for formal, shorts in NICKNAMES.items() for short in shorts}
KNOWN = sorted({*FORMAL, *NICKNAMES})

SHORT_FORMS: dict[str, set[str]] = {}
for _name in KNOWN:
    for _form in deletions(_name):
        SHORT_FORMS.setdefault(_form, set()).add(_name)


def formal(given: str, mentions: int = 0, heard: dict[str, int] | None = None) -> str:
    """The full form of a given name, which may also be a slip of a known one.

    ``heard`` has the mentions of each full name in all its forms. A slip is what hardly occurs, or a third as
    often at most as the name it is taken for, as in :func:`token_map`.
    """
    if given in FORMAL or given in NICKNAMES:
        return FORMAL.get(given, given)
    if len(given) < 3:
        return given
    near = {n for form in deletions(given) for n in SHORT_FORMS.get(form, ()) if distance(given, n, 1) <= 1 and n[0] == given[0]}
    full = {FORMAL.get(n, n) for n in near}
    if len(full) != 1:
        return given
    name = full.pop()
    return name if mentions <= 2 or (heard or {}).get(name, 0) >= 3 * mentions else given


def fold(text: str) -> str:
    """Lower case without accents or look-alike letters."""
    text = unicodedata.normalize("NFKD", skeleton(text).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae"))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def parse(spelling: str) -> tuple[str, list[str], list[str], int, bool]:
    """(kind, words, initials, family word or -1, certain) of one spelling.

    Words are folded; particles are joined to the word they precede, hyphens and apostrophes left out.
    """
    bare = re.sub(r"\([^)]*\)", " ", spelling)
    raw = re.findall(r"[^\W\d_](?:[^\W_]|['’\-](?=\w)|[̀-ͯ])*\.?|,", skeleton(bare))
    folded = [fold(t.rstrip(".")).replace("-", "").replace("'", "").replace("’", "") for t in raw]
    if any(t in BODY_WORDS for t in folded):
        return "body", [t + ("." if r.endswith(".") else "") for t, r in zip(folded, raw, strict=True) if t and t != "," and t not in IDLE_WORDS], [], -1, True
    kept = [(r.rstrip("."), t) for r, t in zip(raw, folded, strict=True) if t not in TITLES]
    if sum(len(t) > 1 for _, t in kept) <= 1 and not any(len(t) == 1 and t != "," for _, t in kept):
        kept = [(r.rstrip("."), t) for r, t in zip(raw, folded, strict=True)]  # "Family MD": the letters are initials
    while kept and kept[-1][1] == ",":
        kept.pop()
    words: list[str] = []
    shouted: list[bool] = []
    initials: list[str] = []
    comma, prefix = -1, ""
    mixed = any(r != r.upper() for r, t in kept if len(t) > 1)
    for k, (r, t) in enumerate(kept):
        following = next((x for _, x in kept[k + 1 :]), "")
        if t == ",":
            comma = len(words) if comma < 0 else comma
        elif t in PARTICLES and len(following) > 1 and not (r.isupper() and len(r) <= 2 and not mixed):
            prefix += t
        elif len(t) == 1 or (len(t) <= 3 and r.isupper() and (mixed or not re.search("[aeiou]", t) or k == len(kept) - 1) and any(len(x) > 3 for _, x in kept)):
            initials.extend(t)
        elif t:
            words.append(prefix + t)
            shouted.append(len(t) > 1 and r.isupper())
            prefix = ""
    if comma == 1 or (comma > 0 and initials and comma == len(words)):
        return "person", words, initials, 0, True
    if len(words) == 1:
        return "person", words, initials, 0, bool(initials)
    if sum(shouted) == 1 and mixed:
        return "person", words, initials, shouted.index(True), True
    return "person", words, initials, -1, False


def alike(a: str, b: str) -> float | None:
    """Cost of taking token ``a`` for ``b``: equal 0, nickname or abbreviation, initial, one or two edits; None: not alike."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        x, y = FORMAL.get(a, a), FORMAL.get(b, b)
        return 0.2 if a[0] == b[0] or x[0] == y[0] else None
    if FORMAL.get(a, a) == FORMAL.get(b, b):
        return 0.1
    d = distance(a, b, 2)
    if d <= (2 if min(len(a), len(b)) >= 6 else 1) and min(len(a), len(b)) >= 4:
        return 0.4 * d
    best = min((distance(x, y, 1) for x in (a, FORMAL.get(a, a)) for y in (b, FORMAL.get(b, b))), default=2)
    return 0.5 if best <= 1 and min(len(a), len(b)) >= 3 else None


def assignment(a: list[str], b: list[str]) -> float | None:
    """Least total cost of giving each token of the shorter name a token of the longer; None if impossible.

    Shortest augmenting paths with potentials, so names of any length are aligned whole.
    """
    few, many = sorted((a, b), key=len)
    never = 1e6
    cost = [[never if (c := alike(x, y)) is None else c for y in many] for x in few]
    n, m = len(few), len(many)
    u, v, taken = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        taken[0], column = i, 0
        least, back, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while taken[column]:
            used[column] = True
            row, delta, following = taken[column], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = cost[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], back[j] = slack, column
                    if least[j] < delta:
                        delta, following = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[taken[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            column = following
        while column:
            taken[column] = taken[back[column]]
            column = back[column]
    total = sum(cost[taken[j] - 1][j - 1] for j in range(1, m + 1) if taken[j])
    return None if total >= never else total


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, n, *parse(s)) for s, n in zip(pdf["spelling"], pdf["n"], strict=True)]
        yield pd.DataFrame(rows, columns=["spelling", "n", "kind", "words", "initials", "family", "certain"])


def spellings(df: DataFrame, column: str = "authors") -> DataFrame:
    """(spelling, n): the distinct pieces of the lists, with the number of their rows."""
    piece = F.explode(F.split(F.col(column), "(?:;| and )")).alias("piece")
    trimmed = df.where(F.col(column).isNotNull()).select(piece).select(F.regexp_replace("piece", r"(?U)^\s+|\s+$", "").alias("spelling"))
    return trimmed.where(~F.col("spelling").rlike(r"(?i)^(et\.?\s+al\.?)?$")).groupBy("spelling").agg(F.count("*").alias("n"))


def token_map(tokens: DataFrame) -> DataFrame:
    """(token, stands_for) for tokens that are taken for a slip of a more frequent one.

    ``tokens`` is (token, spellings, n). A token gives way to its best neighbour within one edit if it stands
    in at most two spellings, or in a third of the neighbour's; a well-known given name never does. A token of
    three letters gives way by the third only, and none is taken for a known given name across three letters:
    :func:`formal` does that, where the role of the token is known.
    """

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(form, t, s, n) for t, s, n in zip(pdf["token"], pdf["spellings"], pdf["n"], strict=True) for form in deletions(t)]
            yield pd.DataFrame(rows, columns=["form", "token", "spellings", "n"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[distance(a, b, 1) == 1 for a, b in zip(pdf["token"], pdf["other"], strict=True)]]

    posted = cut(tokens.where(F.length("token") >= 3).mapInPandas(post, "form string, token string, spellings long, n long"))
    other = posted.select("form", F.col("token").alias("other"), F.col("spellings").alias("other_spellings"), F.col("n").alias("other_n"))
    better = F.struct("other_spellings", "other_n", "other") > F.struct("spellings", "n", "token")
    gives_way = ((F.length("token") >= 4) & (F.col("spellings") <= 2)) | (F.col("other_spellings") >= 3 * F.col("spellings"))
    known = F.col("token").isin(*KNOWN)  # well-known given names are no slips
    by_role = (F.least(F.length("token"), F.length("other")) < 4) & F.col("other").isin(*KNOWN)
    met = posted.join(other, "form").where((F.col("token") != F.col("other")) & better & gives_way & ~known & ~by_role).drop("form").distinct()
    chosen = met.mapInPandas(near, met.schema).groupBy("token").agg(F.max_by("other", F.struct("other_spellings", "other_n", "other")).alias("stands_for"))
    chosen = cut(chosen)
    onward = chosen.select(F.col("token").alias("stands_for"), F.col("stands_for").alias("further"))
    return chosen.join(onward, "stands_for", "left").select("token", F.coalesce("further", "stands_for").alias("stands_for"))


def _resolved(batches: Iterator[pd.DataFrame], heard: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Family, given name and initials of a person; the bag of words of a body."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            words = sorted(r.seen, key=lambda w: w["at"])
            tokens = [w["token"] for w in words]
            if r.kind == "body":
                out.append((r.spelling, r.n, r.kind, " ".join(sorted(t.rstrip(".") for t in tokens)), None, "", " ".join(tokens)))
                continue
            family = r.family
            if family < 0 and len(tokens) >= 2:
                known = [2 if w["token"] in NICKNAMES or formal(w["token"], w["given"], heard) != w["token"] else 0 for w in words]
                odds = [(w["given"] + k + 0.5) / (w["named"] + 0.5) for w, k in zip(words, known, strict=True)]
                family = len(tokens) - 1 if odds[0] >= odds[-1] else 0
            initials = "".join(r.initials)
            if not tokens:
                out.append((r.spelling, r.n, r.kind, None, None, initials, " ".join(initials)))
                continue
            family = max(family, 0)
            rest = [t for i, t in enumerate(tokens) if i != family]
            if rest:
                rest[0] = formal(rest[0], next(w["given"] for i, w in enumerate(words) if i != family), heard)
            given = rest[0] if rest else None
            letters = (given[0] if given else "") + "".join(t[0] for t in rest[1:]) + initials
            out.append((r.spelling, r.n, r.kind, tokens[family], given, letters, " ".join([tokens[family], *rest, *initials])))
        yield pd.DataFrame(out, columns=["spelling", "n", "kind", "family", "given", "letters", "tokens"])


def _expanded(words: DataFrame) -> DataFrame:
    """(token, stands_for): abbreviations in the names of bodies and the full words they shorten.

    Full words are those that stand in many bodies; the most frequent one that begins with the
    abbreviation is taken, else the most frequent one whose letters hold it in order. Both meet under the
    abbreviation's first three letters (two, if it has no more), in order anywhere in the full word.
    """
    counted = words.where("kind = 'body'").groupBy("token").agg(F.countDistinct("spelling").alias("bodies"))
    short = counted.where(F.col("token").endswith(".")).select("token", F.expr("rtrim('.', token)").alias("abbr")).where("length(abbr) between 2 and 8")
    full = counted.where(~F.col("token").endswith(".") & (F.length("token") >= 4)).select(F.col("token").alias("full"), "bodies").where("bodies >= 2")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, w, n) for w, n in zip(pdf["full"], pdf["bodies"], strict=True) for h in {w[0] + x for k in (1, 2) for x in map("".join, combinations(w[1:], k))}]
            yield pd.DataFrame(rows, columns=["head", "full", "bodies"])

    fits = F.regexp_like("full", F.concat(F.lit("^"), F.regexp_replace("abbr", "(.)", "$1.*")))
    met = short.withColumn("head", F.substring("abbr", 1, 3)).join(full.mapInPandas(heads, "head string, full string, bodies long"), "head").where(fits & (F.length("full") > F.length("abbr")))
    return met.groupBy("token").agg(F.max_by("full", F.struct(F.col("full").startswith(F.col("abbr")), "bodies", "full")).alias("stands_for"))


def people(df: DataFrame, column: str = "authors") -> DataFrame:
    """(spelling, n, who): each distinct spelling with the key of the person or body it stands for."""
    parsed = cut(spellings(df, column).mapInPandas(_parsed, "spelling string, n long, kind string, words array<string>, initials array<string>, family int, certain boolean"))
    words = parsed.select("spelling", "n", "kind", "family", "certain", F.size("words").alias("of"), F.posexplode("words").alias("at", "token"))
    # Tokens of bodies are told from those of people by their abbreviations being written out first.
    full = _expanded(words)
    words = words.join(full, "token", "left").withColumn("token", F.coalesce("stands_for", F.expr("rtrim('.', token)"))).drop("stands_for")
    counted = words.groupBy("token").agg(F.countDistinct("spelling").alias("spellings"), F.sum("n").alias("n"))
    slips = cut(token_map(counted))
    words = cut(words.join(slips, "token", "left").withColumn("token", F.coalesce("stands_for", "token")).drop("stands_for"))
    sure = words.where("kind = 'person' and certain and of >= 1")
    votes = sure.groupBy("token").agg(F.sum((F.col("at") == F.col("family")).cast("long")).alias("named"), F.sum((F.col("at") != F.col("family")).cast("long")).alias("given"))
    heard: dict[str, int] = {}
    for r in votes.where(F.col("token").isin(*KNOWN)).select("token", "given").collect():  # no more rows than the fixed list has names
        name = FORMAL.get(r["token"], r["token"])
        heard[name] = heard.get(name, 0) + r["given"]
    zero = F.lit(0).cast("long")
    seen = words.join(votes, "token", "left").groupBy("spelling").agg(F.collect_list(F.struct("at", "token", F.coalesce("named", zero).alias("named"), F.coalesce("given", zero).alias("given"))).alias("seen"))
    whole = parsed.select("spelling", "n", "kind", "initials", "family").join(seen, "spelling")
    known = cut(whole.mapInPandas(lambda batches: _resolved(batches, heard), "spelling string, n long, kind string, family string, given string, letters string, tokens string"))

    bodies = known.where("kind = 'body'").select("spelling", "n", "tokens", F.concat(F.lit("body|"), "family").alias("who"))
    persons = known.where("kind = 'person' and family is not null").withColumn("middle", F.substring("letters", 2, 1))
    # Full given names: one person, unless their middle initials tell several apart.
    named = persons.where("given is not null")
    middles = named.where("middle <> ''").groupBy("family", "given").agg(F.countDistinct("middle").alias("several"), F.min("middle").alias("only"))
    named = named.join(middles, ["family", "given"], "left").withColumn("middle", F.when(F.coalesce("several", zero) <= 1, F.coalesce("only", F.lit(""))).otherwise(F.col("middle")))
    named = cut(named.select("spelling", "n", "tokens", "family", "given", "middle", "several", F.concat_ws("|", "family", "given", "middle").alias("who")))
    # Initials: joined to the one person of that family whom they fit.
    first = named.where("not (coalesce(several, 0) > 1 and middle = '')").select("family", F.substring("given", 1, 1).alias("initial"), "middle", "who").distinct()
    per = first.groupBy("family", "initial", "middle").agg(F.count("*").alias("k"), F.min("who").alias("one"))
    any_ = first.groupBy("family", "initial").agg(F.count("*").alias("k_any"), F.min("who").alias("one_any"))
    short = persons.where("given is null").withColumn("initial", F.substring("letters", 1, 1))
    exact = per.where("middle <> ''").select("family", "initial", "middle", F.col("k").alias("k_exact"), F.col("one").alias("one_exact"))
    open_ = per.where("middle = ''").select("family", "initial", F.col("k").alias("k_open"), F.col("one").alias("one_open"))
    short = short.join(exact, ["family", "initial", "middle"], "left").join(open_, ["family", "initial"], "left").join(any_, ["family", "initial"], "left")
    fit = (
        F.when(F.col("initial") == "", F.lit(None))
        .when(F.col("middle") == "", F.when(F.col("k_any") == 1, F.col("one_any")))
        .when(F.col("k_exact") == 1, F.col("one_exact"))
        .when(F.col("k_exact").isNull() & (F.col("k_open") == 1), F.col("one_open"))
    )
    own = F.concat_ws("|", "family", F.concat(F.lit("~"), F.col("initial")))
    short = short.withColumn("fit", fit)
    lone = short.where("fit is null")
    letters = lone.where("middle <> ''").groupBy("family", "initial").agg(F.countDistinct("middle").alias("several"), F.min("middle").alias("only"))
    lone = lone.join(letters, ["family", "initial"], "left").withColumn("middle", F.when(F.coalesce("several", zero) <= 1, F.coalesce("only", F.lit(""))).otherwise(F.col("middle")))
    lone = lone.select("spelling", "n", "tokens", F.when(F.col("initial") == "", F.concat(F.lit("?"), "spelling")).otherwise(F.concat_ws("|", own, "middle")).alias("who"))
    joined = named.select("spelling", "n", "tokens", "who").unionByName(short.where("fit is not null").select("spelling", "n", "tokens", F.col("fit").alias("who"))).unionByName(lone).unionByName(bodies)
    return _confirmed(joined)


def _confirmed(members: DataFrame) -> DataFrame:
    """Keeps a spelling with its person only if its tokens can be assigned to the person's fullest spelling."""
    members = cut(members)
    fullest = members.groupBy("who").agg(F.max_by("tokens", F.struct(F.length("tokens"), "n", "spelling")).alias("fullest"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            who = []
            for s, t, f, w in zip(pdf["spelling"], pdf["tokens"], pdf["fullest"], pdf["who"], strict=True):
                a, b = t.split(), f.split()
                cost = 0.0 if w.startswith("body|") and sorted(a) == sorted(b) else assignment(a, b)
                who.append(w if cost is not None and cost <= 1.2 else "?" + s)
            yield pd.DataFrame({"spelling": pdf["spelling"], "n": pdf["n"], "who": who})

    return members.join(fullest, "who").select("spelling", "n", "tokens", "who", "fullest").mapInPandas(confirm, "spelling string, n long, who string")


def name_pairs(df: DataFrame, column: str = "authors") -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: different spellings of the same person or body."""
    members = cut(people(df, column))
    a = members.select(F.col("spelling").alias("name_a"), "who")
    b = members.select(F.col("spelling").alias("name_b"), "who")
    return a.join(b, "who").where("name_a < name_b").select("name_a", "name_b")
