"""Problem 8: one consistent form for text that looks the same but is stored in other characters.

Method: a confusables skeleton. Decompose the text (NFD), replace every character by the prototype
of its look-alike class, decompose again; originals with equal skeletons look the same.

The prototype table is built from the Unicode character database by rule (wide, narrow, joined and
compatibility forms stand for the plain characters they are made of, but for an explicit list of letters that a
reader tells apart and for accents that stand alone; format characters show nothing, every space shows as a
space) plus fixed alphabets of foreign letters and signs. Raised and lowered figures, accents, case and line ends
are visible and stay.

Defined results: a null text has a null skeleton and joins no group; text that shows nothing at all
(empty, or only characters without width and blanks) joins no group; equal stored texts are one class
and never a pair; repeated rows of one id count once per id; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.session import cut, spread

# Foreign letters and signs, and what they look like, position by position.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝҮүѴѵӀӏӔӕԌԜԚ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxdhqwYyVvIlÆæGWQ"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϹϳͿ"
GREEK_AS = "ABEZHIKMNOPTYXaivopucCjJ"
SMALL_K = "κк"  # both show as the small k without an ascender
ARMENIAN = "ՕօոսհցզՏԼ"
ARMENIAN_AS = "OonuhgqSL"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏙᏚᏞᏟᏢᏦᏮᎥᏂᏏ"
CHEROKEE_AS = "DRTAJEWMHGZ4VSLCPK6ihb"
LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPdDTGKJCZFMNLSRVHWXYAEIOU"
LATIN = "ıɑɡɩʋȷ"
LATIN_AS = "iagiuj"
SIGNS = "µ‐‑‒–−﹘․⁄∕‘’‛ʹʼʻˈ′‚∶ꓺ꞉"
SIGNS_AS = "μ------.//'''''''',:::"
FOLDED = ("wide", "narrow", "compat", "font", "noBreak", "square")
# Compatibility letters that a reader tells from the plain ones.
VISIBLE = "ſϐϑϒϕϖϰϱϴϵ"


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str | None]:
    """Code point -> what it shows as (None: nothing). Built once in each worker."""
    table: dict[int, str | None] = {}
    for point in range(0x80, 0x30000):
        if 0xAC00 <= point < 0xE000:
            continue
        char = chr(point)
        category = unicodedata.category(char)
        if category == "Cf" or 0xFE00 <= point <= 0xFE0F or point in (0x034F, 0x115F, 0x1160, 0x3164):
            table[point] = None
        elif category == "Zs":
            table[point] = " "
        else:
            parts = unicodedata.decomposition(char)
            if parts.startswith("<") and parts[1 : parts.index(">")] in FOLDED and char not in VISIBLE and "> 0020" not in parts:
                table[point] = unicodedata.normalize("NFKD", char)
    table[9] = " "
    for char in range(0xE0000, 0xE0200):
        table[char] = None
    for group, shown in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (SMALL_K, "ĸĸ"), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (LISU, LISU_AS), (LATIN, LATIN_AS), (SIGNS, SIGNS_AS)):
        table.update({ord(a): b for a, b in zip(group, shown, strict=True)})
    return table


def skeleton(text: str | None) -> str | None:
    """The skeleton of one text; null stays null."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    shown = unicodedata.normalize("NFD", text).translate(prototypes())
    return unicodedata.normalize("NFD", shown)


def consistent(text: str | None) -> str | None:
    """The skeleton in composed form, for people and for comparisons."""
    shown = skeleton(text)
    return None if shown is None else unicodedata.normalize("NFC", shown)


@F.pandas_udf(StringType())
def consistent_text(texts: pd.Series) -> pd.Series:
    """Column form of :func:`consistent`."""
    return texts.map(consistent, na_action="ignore")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shown, stored = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            form = skeleton(text)
            if not form.strip():
                continue
            ids.append(key)
            shown.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
            stored.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(shown, pa.binary()), pa.array(stored, pa.binary())], names=["id", "shown", "stored"])


def text_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shown, stored): 128-bit digests of what each text shows and of how it is stored.

    Texts themselves never leave the scan's task, so the shuffles behind it carry 40 bytes a row.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_digests, f"id {kind}, shown binary, stored binary")


def same_look_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id, class_id, n_forms): every text whose look is stored in more than one way.

    ``group_id`` is the smallest id that looks the same, ``class_id`` the smallest id stored in the
    same characters. Copies are folded before the shuffle on the look, so a look that a third of all
    rows share costs one row per stored form there.
    """
    forms = cut(text_forms(df, id_col, text_col))
    classes = forms.groupBy("shown", "stored").agg(F.min("id").alias("class_id"))
    looks = classes.groupBy("shown").agg(F.min("class_id").alias("group_id"), F.count("*").alias("n_forms")).where("n_forms > 1")
    return forms.join(looks, "shown").join(classes, ["shown", "stored"]).select("id", "group_id", "class_id", "n_forms").distinct()


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows that look the same and are stored in different characters.

    Looks stored in one way only are removed before the self-join, so plain copies, however many, are
    never paired.
    """
    members = cut(same_look_groups(df, id_col, text_col))
    a = members.select(F.col("id").alias("id_a"), "group_id", F.col("class_id").alias("class_a"))
    b = members.select(F.col("id").alias("id_b"), "group_id", F.col("class_id").alias("class_b"))
    return a.join(b, "group_id").where("id_a < id_b and class_a <> class_b").select("id_a", "id_b")
