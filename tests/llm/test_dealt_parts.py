"""The dealt operators' parts in plain Python: distances, parsing, titles, packing, skeletons."""

import random
from itertools import product

import pytest

from quire.llm import channel, chosenpath, confusables, edits, history, names, packing


def naive(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            rows[i][j] = i + j
            continue
        rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_distance_and_deletions():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(2))
        assert edits.distance(a, b, 2) == min(naive(a, b), 3)
        if a and b and naive(a, b) <= 1 and len(a) > 1 and len(b) > 1:
            assert edits.deletions(a) & edits.deletions(b)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｆｕｌｌ ｗｉｄｔｈ １２％", "Full width 12%", True),
        ("été", "été", True),
        ("zero​width­", "zerowidth", True),
        ("non breaking　space", "non breaking space", True),
        ("Сосоа", "Cocoa", True),
        ("ﬁne oﬃce", "fine office", True),
        ("co‐op", "co-op", True),
        ("10 µg", "10 μg", True),
        ("m²", "m2", False),
        ("H₂O", "H2O", False),
        ("été", "ete", False),
        ("Abc", "abc", False),
        ("a\nb", "a b", False),
        ("β", "ß", False),
        ("l0", "lO", False),
        ("a.", "a,", False),
        ("αριυκıɑօӏɡѵ", "apiu" + "ĸ" + "iaolgv", True),
        ("ᎪᏚᎬ ꓮꓢ", "ASE AS", True),
        ("5 − 3", "5 - 3", True),
        ("l’été", "l'été", True),
        ("ſ", "s", False),
        ("ϑϖ", "θπ", False),
        ("¨a", " ̈a", False),
    ],
)
def test_skeletons(a, b, same):
    assert (confusables.skeleton(a) == confusables.skeleton(b)) is same
    assert confusables.skeleton(confusables.skeleton(a)) == confusables.skeleton(a)
    assert confusables.consistent(None) is None and confusables.skeleton("") == ""


@pytest.mark.parametrize(
    ("spelling", "family", "given"),
    [
        ("Wanjiru M. van Nuprebusar", "vannuprebusar", "wanjiru"),
        ("VAN DROKIVOSER, Jenny V.", "vandrokivoser", "jenny"),
        ("de laHitekilor C", "delahitekilor", None),
        ("Brilujago, S. V., MD", "brilujago", None),
        ("Hanneke TVOREBIDA (MPH)", "tvorebida", "hanneke"),
        ("Dr. Tostekrumi PA", "tostekrumi", None),
        ("Zokraputa ZA, PhD", "zokraputa", None),
        ("Ulrike N. Grotroheran", None, None),
    ],
)
def test_names_are_parsed(spelling, family, given):
    kind, words, initials, at, certain = names.parse(spelling)
    assert kind == "person"
    if family:
        assert words[max(at, 0)] == family or (at < 0 and family in words)
        assert given is None or given in words
        assert given or initials
    else:
        assert not certain and words == ["ulrike", "grotroheran"] and initials == ["n"]


def test_names_are_aligned():
    assert names.assignment(["smith", "j"], ["smith", "john", "p"]) == pytest.approx(0.2)
    assert names.assignment(["smith", "bob"], ["smith", "robert"]) == pytest.approx(0.1)
    assert names.assignment(["smith", "maria"], ["smith", "peter"]) is None
    assert names.formal("gaabe") == "gabriel" and names.formal("nikc") == "nicholas" and names.formal("bob") == "robert" and names.formal("ingrid", 40) == "ingrid"
    long = [f"name{i}" for i in range(14)]
    assert names.assignment(long, long[::-1]) == 0.0
    assert names.parse("")[1] == [] and names.parse("et al.")[0] == "person"
    assert names.parse("On behalf of the Xyz Study Grp. (XSG)")[0] == "body"


def test_titles():
    same = history.same_title
    assert same("effect of iron on sleep in children rivormer", "effect of iron sleep on children rivormer")
    assert same("randomised trial of aspirin rivormer", "randomized trial of aspirin rivormer")
    assert not same("trial of aspirin part 1", "trial of aspirin part 2")
    assert not same("trial of aspirin part i", "trial of aspirin part ii")
    assert not same("trial of aspirin in rivormer", "trial of aspirin in gradonda")
    assert same("trial of aspirin in rivom", "trial of aspirin in rivxmy") and same("trial of aspirin in rivxmy", "trial of aspirin in rivom")
    # The first word is nearer to the one word that the second needs.
    assert same("trial of pandemovic pandemxxir", "trial of pandemovir pandemosac") and same("trial of pandemovir pandemosac", "trial of pandemovic pandemxxir")
    assert not same("trial of pandemovic pandemxxir", "trial of pandemovir pandemovirxyz")
    assert history.normalise("Été — ﬁn de l’Étude!") == "ete fin de l etude"
    assert history.normalise(None) == ""
    speller = history.Speller({"treatment": 50, "study": 40})
    assert speller.repair("tretament") == "treatment" and speller.repair("rivormer") == "rivormer" and speller.repair("12") == "12"


def test_packing_keeps_all_and_little_space():
    rnd = random.Random(3)
    lengths = [min(4096, int(rnd.paretovariate(1.1) * 40)) for _ in range(3000)] + [0, 0, 4096]
    boxes = packing.pack(lengths, [512, 2048, 4096])
    assert sorted(i for items, _ in boxes for i in items) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in items) <= size for items, size in boxes)
    assert all(size == min(s for s in (512, 2048, 4096) if s >= sum(lengths[i] for i in items)) for items, size in boxes)
    assert sum(size for _, size in boxes) < 1.01 * sum(lengths) + 4096
    assert packing.pack([], [10]) == [] and packing.pack([0], [10]) == [([0], 10)]


def test_chosen_path_arithmetic():
    assert chosenpath.runs_needed(1, 0.6, 0.99) < chosenpath.runs_needed(4, 0.6, 0.99)
    assert chosenpath.shingles("one two three four", 3).size == 2 and chosenpath.shingles("one two", 3).size == 0
    assert chosenpath.shingles("CO₂ m² x", 3).size == 1


def test_channel_reads_through_noise():
    text = "the patients were treated with care in the intensive care units and the patients were followed".split()
    words, pairs = {}, {}
    for _ in range(60):
        for w in text:
            words[w] = words.get(w, 0) + 1
        for p in zip(text, text[1:], strict=False):
            pairs[p] = pairs.get(p, 0) + 1
    words |= {"patlents": 1, "tbe": 1, "#": 50}
    model = channel.Model(words, pairs, {}, sum(words.values()))
    assert model.decode("tbe patlents vvere treatcd with core".split())[:4] == "the patients were treated".split()
    assert model.decode("zorbandal region".split()) == "zorbandal region".split()
    assert model.decode(["2o16"]) == ["#"] and channel.numeric("l12") and not channel.numeric("fev1")
    assert channel.shape("Bulletin | 197S | 81") == channel.shape("Bullctin | 1975 | 82")


def test_channel_keeps_every_reading():
    word = "hrnniiclr"
    readings = {v for v, _, _ in channel.reversals(word)}
    model = channel.Model(dict.fromkeys(readings, 100), {}, {}, 100 * len(readings))
    assert len(readings) > 12 and {v for v, _ in model.candidates(word)} == {word, *readings}


def test_confusions_keep_the_strokes():
    """All readings of a word fall into its bucket, so judging buckets equals judging the whole vocabulary."""
    assert all(t.translate(channel.STROKES) == s.translate(channel.STROKES) for t, s in channel.CONFUSIONS)
    assert channel.strokes("S8") == channel.strokes("58") == "#58"


def test_codes_are_no_misread_numbers():
    assert channel.tokens("b12 t4 b6 1st 20s 5g il6 q10 DNA 37 B3") == ["b12", "t4", "b6", "1st", "20s", "5g", "il6", "q10", "dna", "#", "B3"]
    assert not any(map(channel.numeric, "b12 t4 b6 1st 20s 5g il6 q10".split()))
    model = channel.Model({"B12": 50, "l2": 4, "#": 4000, "vitamin": 60}, {("vitamin", "B12"): 50}, {}, 10_000, {"812": 30, "12": 300})
    assert model.decode(["vitamin", "B12"]) == ["vitamin", "B12"] and model.decode(["vitamin", "l2"]) == ["vitamin", "#"]
