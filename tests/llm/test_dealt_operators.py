"""The dealt operators on frames: brute force, nulls, empties, repeats, ties, long texts, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import channel, chosenpath, confusables, history, mixing, names, packing, queries, scans, tokens


def test_same_look_pairs(spark):
    rows = [(1, "café ﬁn"), (2, "café fin"), (3, "café fin"), (3, "café fin"), (4, "cafe fin"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "x" * 50_000 + "а"), (10, "x" * 50_000 + "a")]
    frame = spark.createDataFrame([(*r, 0, b"") for r in rows], "doc_id long, text string, group_id int, shown binary")
    got = [tuple(r) for r in confusables.same_look_pairs(frame).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (9, 10)]
    assert confusables.same_look_pairs(frame.limit(0)).count() == 0
    text = {r["doc_id"]: r["c"] for r in frame.select("doc_id", confusables.consistent_text("text").alias("c")).collect()}
    assert text[1] == text[2] == "café fin" and text[5] is None


def records(n=260):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            words = rnd.choice(out)[2].split()
            for _ in range(rnd.randrange(0, 8)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(60)]
        out.append((i, "Title", " ".join(words)))
    return out + [(900, None, "Same words here again"), (901, "", "same WORDS here again"), (902, "t", None), (903, "t", " "), (904, None, "two words"), (905, None, "long " + "word " * 9000), (906, None, "long " + "word " * 9001)]


def test_near_duplicates_equal_brute_force(spark):
    rows = records()
    frame = spark.createDataFrame([(*r, "x", 1) for r in [*rows, rows[0]]], "doc_id long, title string, abstract string, sketch string, rep int")
    sets = {}
    for i, title, abstract in rows:
        if abstract and abstract.strip():
            w = re.findall(r"[^\W_]+", f"{title or ''} {abstract}".lower())
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in chosenpath.near_duplicate_pairs(frame, bucket=8, recall=0.999).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and (900, 901) in got and (905, 906) in got
    groups = {r["id"]: r for r in chosenpath.near_duplicate_groups(frame, bucket=8).collect()}
    assert groups[900]["class_id"] == groups[901]["class_id"] == 900 and 902 not in groups
    assert chosenpath.near_duplicate_pairs(frame.limit(0)).count() == 0


def test_hot_buckets_are_split(spark):
    base = [f"w{i}" for i in range(80)]
    rnd = random.Random(1)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(3):
            words[rnd.randrange(80)] = f"u{rnd.randrange(10**6)}"
        rows.append((i, "", " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, title string, abstract string")
    plain = chosenpath.near_duplicate_pairs(frame, bucket=10).count()
    split = chosenpath.near_duplicate_pairs(frame, bucket=10, hot=30).count()
    assert plain > 0 and abs(plain - split) <= 0.03 * plain


def test_hot_buckets_equal_brute_force(spark):
    """Pairs met through buckets that Spark splits, against a comparison of every two sets."""
    base = [f"w{i}" for i in range(60)]
    rnd = random.Random(2)
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(60)] = f"u{rnd.randrange(10**6)}"
        rows.append((i, "", " ".join(words)))
    sets = {i: set(zip(w, w[1:], w[2:], strict=False)) for i, w in ((i, t.split()) for i, _, t in rows)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame(rows, "doc_id long, title string, abstract string")
    got = {tuple(r) for r in chosenpath.near_duplicate_pairs(frame, bucket=10, hot=25).collect()}
    assert want and got <= want and len(got) >= 0.99 * len(want)


def test_block_buckets_lose_no_pair(spark):
    """Equal sketches never part, so blocks of a hot bucket are compared whole: every pair is met, exactly once."""
    sketch = np.arange(chosenpath.WIDTH, dtype=np.uint8)
    pairs = {(a, b) for a in range(90) for b in range(90) if a < b}
    for threshold, levels in [(0.6, 0), (0.8, 0), (0.6, 1), (0.8, 1)]:
        draws = [len(chosenpath.children(np.array([p], np.uint64), sketch[None], threshold)[0]) > 0 or not levels for p in range(1, 9)]
        nodes = spark.createDataFrame([(p, p * 100 + i, sketch.tobytes(), levels) for p in range(1, 9) for i in range(90)], chosenpath.NODE)
        got = [tuple(r) for r in chosenpath._met(chosenpath._split_hot(nodes, threshold, 20, levels), threshold, 5).collect()]
        want = {(p * 100 + a, p * 100 + b) for p, on in enumerate(draws, 1) if on for a, b in pairs}
        assert len(got) == len(want) and set(got) == want


def test_levels_already_taken_count():
    """A bucket that came to a task with no levels left is compared whole, whatever its node would draw."""
    sketch = np.tile(np.arange(chosenpath.WIDTH, dtype=np.uint8), (180, 1))
    paths = np.repeat(np.arange(20, dtype=np.uint64), 9)
    got = np.concatenate(list(chosenpath.split_and_compare(np.arange(180), sketch, paths, np.zeros(180, np.int32), 0.6, 5, 0.3)))
    assert {tuple(r) for r in got.tolist()} == {(a, b) for a in range(180) for b in range(a + 1, 180) if a // 9 == b // 9}


def test_name_pairs(spark):
    lists = [
        "Anthony J. Kadredugren; V. Grotroheran", "Tony KADREDUGREN", "Kadredugren, A.", "Kadredugren, Anthony, PhD", "Anthoyn Kadredugren; et al.", "Victoria G. Grotroheran and Robert Grotroheran",
        "Bob Grotroheran", "Ann B. Zuprehora; Ann C. Zuprehora", "A. Zuprehora", "Airway Consort. of Bogrupada; on behalf of the Bogrupada Airway Consortium", "Tokreroma Airway Consortium; Tokreroma Airway Consortium",
        None, "", " ; ", "et al.",
    ]
    frame = spark.createDataFrame([(x, "clash", "clash") for x in lists * 2], "authors string, spelling string, who string")
    got = {tuple(r) for r in names.name_pairs(frame).collect()}
    assert all(a < b for a, b in got)
    for a, b in [("Anthony J. Kadredugren", "Tony KADREDUGREN"), ("Kadredugren, A.", "Kadredugren, Anthony, PhD"), ("Anthony J. Kadredugren", "Anthoyn Kadredugren"), ("V. Grotroheran", "Victoria G. Grotroheran"), ("Bob Grotroheran", "Robert Grotroheran"), ("Airway Consort. of Bogrupada", "on behalf of the Bogrupada Airway Consortium")]:
        assert (min(a, b), max(a, b)) in got, (a, b)
    assert not any("Zuprehora" in a for a, _ in got)
    assert not any("Victoria" in a and "ob" in b for a, b in got)
    assert names.name_pairs(frame.limit(0)).count() == 0


def test_frequent_slips_of_short_names(spark):
    """A slip typed for many people is told by its share, not by a fixed number, and in names of three letters too."""
    families = ["Kadredugren", "Grotroheran", "Zuprehora", "Tostekrumi", "Brilujago"]
    lists = [f"{f}, {given}" for f in families for given in ("Alx", "Alexander", "Alexander P.", "Alex", "Sandy")]
    lists += ["Kem, Robert", "Keem, Robert", "Kem, Anthony", "Kem, V.", "Lem, Robert", "Lem, Victoria", "Lem, William"]
    got = {tuple(r) for r in names.name_pairs(spark.createDataFrame([(x,) for x in lists], "authors string")).collect()}
    for f in families:
        assert (f"{f}, Alexander", f"{f}, Alx") in got
    assert ("Keem, Robert", "Kem, Robert") in got and ("Kem, Robert", "Lem, Robert") not in got
    assert names.formal("alx", 5, {"alexander": 15}) == "alexander" and names.formal("alx", 5, {"alexander": 14}) == "alx"


def test_newcomers(spark):
    long = "Effect of intravenous iron on sleep in children with asthma: the {} cohort"
    rows = [
        (1, 0, long.format("Rivormer"), None, None), (2, 0, long.format("Gradonda"), "x", "10.99001/abc.1"), (3, 0, "Erratum", None, "n/a"), (4, 0, None, None, None),
        (5, 1, long.format("Rivormer").replace("iron", "irron"), None, None), (6, 1, long.format("Stulonte"), None, "DOI: 10.99001/ABC.1."), (7, 1, "Erratum", None, "n/a"), (8, 1, None, None, ""),
        (9, 2, long.format("Stulonte"), None, None), (10, 2, long.format("Rivormer") + ": part 2", None, None), (11, 2, "Quite another title of sufficient length", None, "10.0000/none"), (12, 2, "", None, "10.0000/none"),
        (13, 2, long.format("Gradonda"), None, "10.99001/other.7"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[4]]], "doc_id long, import_batch int, title string, normalized_title string, doi string, key string")
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    files = spark.createDataFrame([(4, "A" * 63 + "b"), (8, "sha256:" + "a" * 63 + "B"), (3, empty), (7, empty.upper()), (11, None), (12, "")], "document_id long, sha256 string")
    got = {(r["first_id"], r["doc_id"]) for r in history.newcomers(docs, files).collect()}
    assert got == {(1, 5), (2, 6), (2, 9), (4, 8)}
    assert history.newcomers(docs.limit(0), files.limit(0)).count() == 0


def history_rows():
    long = "Effect of intravenous iron on sleep in children with asthma: the {} {} cohort"
    words = ["".join(chr(ord("a") + int(c, 16)) for c in hashlib.md5(str(i).encode()).hexdigest()[:12]) for i in range(64)]
    titles = [(i, 0, long.format(w, w[::-1])) for i, w in enumerate(words)]
    later = [(100 + i, 1 + i % 3, long.format(w[:2] + w[3:], w[::-1])) for i, w in enumerate(words[:12])]  # a letter left out of a rare word
    hot = [(200 + i, 1, f"Outcomes after pandemovir therapy in region {w[3:]}{w[:3]} of the north") for i, w in enumerate(words)]
    hot += [(300, 2, f"Outcomes after pandemovir therapy in region {words[0][4:]}{words[0][:3]} of the north")]
    return [(i, b, t, None, None) for i, b, t in [*titles, *later, *hot, (301, 2, long.format(words[0], "quite"))]]


def works_of(index):
    return {r["doc_id"]: r["work"] for r in index.works().collect()}


def test_history_goes_on_where_it_left_off(spark, tmp_path):
    """An index opened again, in another session, equals one that was never left; nothing is lost or written twice."""
    docs = spark.createDataFrame(history_rows(), "doc_id long, import_batch int, title string, normalized_title string, doi string")
    files = spark.createDataFrame([(1, "a" * 63 + "b"), (205, "A" * 63 + "B")], "document_id long, sha256 string")
    whole = works_of(history.add_all(docs, files))
    path = f"file://{tmp_path}/index"
    for number in range(4):
        again = history.HistoryIndex(spark.newSession(), path)
        assert again.batches == list(range(number))
        again.add(number, docs.where(F.col("import_batch") == number), files.join(docs.where(F.col("import_batch") == number), F.col("doc_id") == F.col("document_id"), "left_semi"))
    opened = history.HistoryIndex(spark, path)
    assert opened.batches == [0, 1, 2, 3] and works_of(opened) == whole
    with pytest.raises(ValueError):
        opened.add(2, docs, files)


def test_slips_of_rare_words_link_in_long_lists_too(spark, monkeypatch):
    docs = spark.createDataFrame(history_rows(), "doc_id long, import_batch int, title string, normalized_title string, doi string")
    files = spark.createDataFrame([], "document_id long, sha256 string")
    want = {(i, 100 + i) for i in range(12)} | {(200, 300)}
    for long in (1000, 5):
        monkeypatch.setattr(history, "LONG", long)
        assert {(r["first_id"], r["doc_id"]) for r in history.newcomers(docs, files).collect()} == want


def slipped(word, rnd):
    at = rnd.randrange(len(word) - 1)
    return rnd.choice([word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[:at] + "q" + word[at + 1 :], word[:at] + word[at + 1] + word[at] + word[at + 2 :]])


def test_every_pair_of_same_titles_links_however_long_the_lists(spark, monkeypatch):
    """All pairs that ``same_title`` accepts, found by comparing all, are linked: with slips in every word, in the only rare word, or between common ones."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghklmnoprstu") for _ in range(n)) for n in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    words += [w[:2] + "z" + w[3:] for w in words[:6]]  # common words that are slips of common words
    titles = [" ".join([*rnd.sample(words, 4), *["pandemovir"] * (i % 3 == 0), "12"[i % 2]]) for i in range(90)]
    later = []
    for i in range(70):
        title = rnd.choice(titles + later).split()
        for at in range(len(title)) if i % 3 == 0 else rnd.sample(range(len(title)), 2):
            for _ in range(rnd.randrange(3)):
                title[at] = slipped(title[at], rnd) if len(title[at]) > 4 else title[at]
        rnd.shuffle(title)
        later.append(" ".join(title))
    later += ["gradonda stulonte pandemovir 1", "gardonda stulontes pandemovir 1", "gradonda stulonte pandemovir 2", *[f"{rnd.choice(words)} {slipped(w, rnd)} pandemovir 1" for w in words]]
    rows = [(i, 1 + (i - 90) % 3 if i >= 90 else 0, f"{t} of the", None, None) for i, t in enumerate(titles + later)]
    docs = spark.createDataFrame(rows, "doc_id long, import_batch int, title string, normalized_title string, doi string")
    files = spark.createDataFrame([], "document_id long, sha256 string")
    work = None
    for long in (1000, 3):
        monkeypatch.setattr(history, "LONG", long)
        index = history.add_all(docs, files)
        if work is None:
            speller = history.Speller(index.common)
            repaired = [" ".join(speller.repair(w) for w in t.split()) for _, _, t, _, _ in rows]
            same = [(a, b) for b in range(len(rows)) for a in range(b) if len(rows[a][2]) >= 24 <= len(rows[b][2]) and history.same_title(repaired[a], repaired[b])]
            work = list(range(len(rows)))
            for _ in rows:
                for a, b in same:
                    work[a] = work[b] = min(work[a], work[b])
            assert index.common and sum(sorted(repaired[a].split()) != sorted(repaired[b].split()) for a, b in same) > 30
        got = works_of(index)
        assert [got.get(i, i) for i in range(len(rows))] == work


def test_slips_in_all_rare_words_link(spark, monkeypatch):
    """Two slips in the only rare word; slips in two rare words while the third stands in a long list."""
    long = "Effect of intravenous iron on sleep in children with asthma: the {} cohort"
    base = [(i, 0, long.format("".join(chr(ord("a") + int(c, 16)) for c in hashlib.md5(str(i).encode()).hexdigest()[:12])), None, None) for i in range(30)]
    pair = [(40, 1, long.format("rivormer"), None, None), (41, 2, long.format("rixorner"), None, None)]
    hot = [(50 + i, 1, f"Outcomes after pandemovir{' plus' * i}", None, None) for i in range(20)]
    hot += [(70 + i, 1, f"Stulonte gradonda pandemovir {i}", None, None) for i in range(10)] + [(80, 2, "Stulonta gradondas pandemovir 7", None, None)]
    docs = spark.createDataFrame([*base, *pair, *hot], "doc_id long, import_batch int, title string, normalized_title string, doi string")
    monkeypatch.setattr(history, "LONG", 5)
    got = {(r["first_id"], r["doc_id"]) for r in history.newcomers(docs, spark.createDataFrame([], "document_id long, sha256 string")).collect()}
    assert got == {(40, 41), (77, 80)}


def test_packing_frames(spark):
    items = spark.createDataFrame([(1, 700), (2, 300), (3, 0), (4, 256), (4, 256), (5, 2500)], "id long, n_tokens long")
    windows = spark.createDataFrame([("small", 256), ("large", 1024), (None, 5)], "window_name string, capacity_tokens int")
    rows = packing.containers(items, windows, lot=3).collect()
    for name, capacity in (("small", 256), ("large", 1024)):
        own = [r for r in rows if r["window_name"] == name]
        assert sum(r["n_tokens"] for r in own) == 700 + 300 + 256 * 2 + 2500
        assert {r["id"] for r in own} == {1, 2, 3, 4, 5} and all(r["filled_tokens"] <= r["container_tokens"] <= capacity for r in own)
        assert all(r["piece_no"] == 1 for r in own if r["id"] in (3, 4))
    report = {r["window_name"]: r for r in packing.unused_space(packing.containers(items, windows)).collect()}
    assert report["large"]["n_split"] == 1 and report["large"]["unused_tokens"] == report["large"]["container_tokens"] - report["large"]["tokens"]
    assert packing.containers(items.limit(0), windows).count() == 0


def test_long_items_never_fill_one_lot(spark):
    """Full pieces are containers of their own before anything is packed, and repeated ids spread over the lots."""
    items = spark.createDataFrame([(1, 1_000_000), (2, 130), *[(7, 40)] * 60], "id long, n_tokens long")
    windows = spark.createDataFrame([("w", 128)], "window_name string, capacity_tokens int")
    rows = packing.containers(items, windows, lot=20).collect()
    assert sum(r["n_tokens"] for r in rows) == 1_000_000 + 130 + 60 * 40 and all(r["filled_tokens"] <= r["container_tokens"] <= 128 for r in rows)
    packed = {}
    for r in rows:
        packed.setdefault(r["container_id"], []).append(r)
    assert all(sum(x["n_tokens"] for x in box) == box[0]["filled_tokens"] for box in packed.values())
    assert sum(k.startswith("full") for k in packed) == 1_000_000 // 128 + 1
    assert len({k.split("-")[0] for k in packed if not k.startswith("full")}) > 1
    assert [r["piece_no"] for r in sorted((r for r in rows if r["id"] == 2), key=lambda r: r["start_token"])] == [1, 2]


def test_mixing_to_a_size(spark):
    """A mix of a size asked for: capped sources fall short and are reported, the others take what is left."""
    items = spark.createDataFrame([(i, 100, "big") for i in range(1000)] + [(5000 + i, 100, "rare") for i in range(2)] + [(6000 + i, 100, "mid") for i in range(300)], "id long, n_tokens long, source string")
    targets = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "rare", 0.2, 2), ("m", "mid", 0.4, 1), ("twice", "Big", 0.5, 1), ("twice", "big ", 0.5, 3)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = mixing.mixture(items, targets, total_tokens=50_000)
    tokens = {(r["mix_name"], r["source"]): r["t"] for r in drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert tokens["m", "rare"] == 400 and abs(tokens["m", "big"] - 24_800) <= 100 and abs(tokens["m", "mid"] - 24_800) <= 100
    assert abs(tokens["twice", "big"] - 50_000) <= 100 and drawn.where("mix_name = 'twice'").agg(F.max("copies")).first()[0] == 1
    report = {(r["mix_name"], r["source"]): r for r in mixing.mixture_report(drawn, targets).collect()}
    assert report["m", "rare"]["shortfall"] == pytest.approx(0.192, abs=0.001) and report["m", "big"]["shortfall"] == 0 and len(report) == 4
    whole = mixing.mixture(items, targets.where("mix_name = 'm'")).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    assert {r["source"]: r["t"] for r in whole.collect()}["rare"] == 400  # without a size, the scarcest source sets it


def test_mixing(spark):
    rnd = random.Random(8)
    sources = ["big"] * 3000 + ["BIG "] * 30 + ["small-one"] * 120 + [None] * 5 + ["other"] * 50
    items = spark.createDataFrame([(i, rnd.randrange(1, 800), s) for i, s in enumerate(sources)] + [(9999, 0, "big")], "id long, n_tokens long, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small_one", 0.5, 3), ("lost", "nowhere", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = mixing.mixture(items, targets)
    rows = drawn.collect()
    assert {r["source"] for r in rows} == {"big", "small_one"} and max(r["copies"] for r in rows if r["source"] == "small_one") == 3
    assert all(r["copies"] <= 2 for r in rows if r["source"] == "big") and 9999 not in {r["id"] for r in rows}
    report = {(r["mix_name"], r["source"]): r for r in mixing.mixture_report(drawn, targets).collect()}
    assert report["m", "big"]["actual_share"] == pytest.approx(0.5, abs=0.03) and report["lost", "nowhere"]["actual_share"] == 0
    assert sorted(map(tuple, mixing.mixture(items, targets).collect())) == sorted(map(tuple, rows))
    assert mixing.mixture(items.limit(0), targets).count() == 0


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "Hello world, hello."), (2, None), (3, ""), (None, "x"), (4, "long " * 20_000)], "doc_id long, text string")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(frame).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(tokens.encoder(tokens.RANKS).encode_ordinary("Hello world, hello.")) and got[4] > 19_000 and len(got) == 4


def pages():
    body = [
        "The patients were treated in intensive care units and followed for twelve", "months. Serious adverse events occurred in many patients, most often severe", "bleeding. Quality of life improved in both groups after the treat-", "ment, and the well-", "known risks of therapy were reported by the participants.",
    ]
    out = []
    openings = [f"{a} {b} {c}" for a in ("Serious", "Severe", "Known", "Many") for b in ("adverse", "twelve", "months") for c in ("events", "groups", "units", "risks", "patients", "therapy", "life", "care", "both", "most")]
    for doc in range(1, 31):
        for page in range(1, 5):
            out.append((doc, page, "\n".join([f"Invented Journal | {1990 + doc} | {page}", "", f"{openings[doc * 4 + page - 5]}. {body[0]}", *body[1:], "A well-known and well-known result with treatment of patients.", "", f"- {page} -"])))
    noisy = out[0][2].replace("patients were", "patlents vvere").replace("Quality", "Qua1ity ^")
    return [(100, 1, noisy), (100, 2, out[1][2].replace("treat-\nment", "treat­\nment")), *out, out[0], (200, 1, None), (201, 1, ""), (202, None, "A lone line")]


def test_defects_and_paragraphs(spark):
    frame = spark.createDataFrame([(*r, "clash", 0) for r in pages()], "document_id long, page_number int, text string, shape string, doc int")
    docs = spark.createDataFrame([(100, "Some title", "Invented Journal"), (1, None, None)], "doc_id long, title string, journal string")
    found = {(r["doc"], r["page"], r["line"], r["defect"]) for r in scans.defects(frame, docs).collect()}
    assert {x for x in found if x[0] == 100 and x[1] == 1} == {(100, 1, 1, "furniture"), (100, 1, 10, "furniture"), (100, 1, 3, "misread"), (100, 1, 5, "misread"), (100, 1, 5, "hyphen")}
    assert {x[2:] for x in found if x[:2] == (100, 2)} == {(1, "furniture"), (10, "furniture"), (5, "hyphen")}
    assert not any(x[0] in (200, 201) for x in found)
    text = {(r["doc"], r["page"]): r["text"] for r in scans.paragraphs(frame, docs).collect()}
    assert "patients were treated" in text[100, 1] and "after the treatment, and the well- known" in text[100, 1].replace("well-known", "well- known") and "the well-known risks" in text[100, 1] and "Journal" not in text[100, 1]
    assert scans.defects(frame.limit(0), docs).count() == 0


def test_signs_codes_and_capitals_survive(spark):
    """What is printed stays: signs beside words and figures, quotes in pairs, codes; capitals stay capitals."""
    clean = "Samples were kept at 37 °C and § 4 and « bonjour » in the ward; vitamin b12 and t4 were given."
    rows = [(r[0], r[1], r[2].replace("\nA well-known", f"\n{clean}\nA well-known")) for r in pages()[2:] if r[2]] + [(300, 1, f"DNA was found in many patients.\nDNA was found in rnany DNA samples.\n{clean}\nThe patients were treated.")]
    frame = spark.createDataFrame(rows, "document_id long, page_number int, text string")
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, title string, journal string")
    found = [r for r in scans.defects(frame, docs).collect() if r["doc"] == 300]
    assert [(r["line"], r["word"], r["best"]) for r in found if r["defect"] == "misread"] == [(2, "rnany", "many")]
    text = {(r["doc"], r["page"]): r["text"] for r in scans.paragraphs(frame, docs).collect()}
    assert clean in text[300, 1] and "found in many DNA samples" in text[300, 1]
    assert scans._cased("RNANY", "many") == "MANY" and scans._cased("Rnany", "many") == "Many" and scans._cased("rnany", "many") == "many"


def test_added_signs_are_told_by_their_places(spark):
    """The same sign is noise between words that follow each other elsewhere, and printed where its places are its own."""
    rnd = random.Random(4)
    rows = []
    for doc in range(300):
        words = ["patients", "were", "treated", "in", "care", "units", "with", "twelve", "known", "risks", "(p", "=", "0.1)"]
        at = rnd.randrange(1, 10)
        rows.append((doc, 1, "\n".join(["Opening line of the page here", "another line", " ".join(words), " ".join([*words[:at], "~", *words[at:]] if doc % 5 == 0 else words), "last line but one of it", "the last line"])))
    frame = spark.createDataFrame(rows, "document_id long, page_number int, text string")
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, title string, journal string")
    found = {(r["doc"], r["line"]) for r in scans.defects(frame, docs).where("defect = 'misread'").collect()}
    assert found == {(doc, 4) for doc in range(0, 300, 5)}


def test_runs_decoded_by_joins_equal_one_task(spark):
    """The joined decoder gives what the channel gives on tables that one task holds."""
    frame = spark.createDataFrame(pages(), "document_id long, page_number int, text string")
    tables = scans.corpus(scans.facts(scans._rows(frame)))
    words = {r["word"]: r["n"] for r in tables.lexicon.collect()}
    pairs = {(r["a"], r["b"]): r["n"] for r in tables.pairs.collect()}
    model = channel.Model(words, pairs, {}, tables.frequent.value.total)
    runs = ["patlents vvere treated", "patlents", "qua1ity", "patients were"]
    keys = spark.createDataFrame([(f"\n{run}\n",) for run in runs], "key string")
    for share in (scans.SHARE, 1.0):  # with and without the frequent words at hand
        bare = tables._replace(frequent=spark.sparkContext.broadcast(tables.frequent.value._replace(entries={}, pairs={}))) if share == 1.0 else tables
        got = {r["key"].strip(): list(r["best"]) for r in scans.decoded(keys, bare).collect()}
        for run in runs:
            assert got.get(run, run.split()) == model.decode(run.split())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_give_rows(spark, data, name):
    frame = queries.queries()[name](spark, data)
    rows = frame.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
        assert frame.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns]).first() == tuple([0] * len(frame.columns))
