"""Visually identical text: skeletons by look-alike prototypes, and the documents that share one.

skeleton(text) = decompose, replace every character by its prototype, decompose again. Texts that look the same have
equal skeletons. Letter case, accents, raised digits, punctuation, line breaks and the number of blanks stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like a letter of another script. Each pair of lines is read column by column.
ALIKE = (
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮӀѴԀ", "ABESIJKMHOPCTYXGQWYIVd"),  # Cyrillic capitals
    ("асеѕіјһорухԁԛԝӏѵүєг", "acesijhopyxdqwlvyɛr"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("ονρϲϳιυασγ", "ovpcjiuaoy"),  # Greek small letters
    ("օոսհզցՕՍԼ", "onuhqgOUL"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4VSLCPKB"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "ABEHIKMNOPCTYX"),  # Coptic capitals
    ("ⲟⲣⲥ", "opc"),  # Coptic small letters
    ("κкⲕ", "ĸĸĸ"),  # small letters of three scripts that look like each other
    ("ıɩɑɡʏ", "iiagy"),  # Latin letters beside the basic ones
)
# Characters without a form of their own besides the class of format characters.
UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
UNSEEN_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))  # variation selectors
FOLDED = ("<wide>", "<narrow>", "<noBreak>")


@cache
def prototypes() -> dict[int, str]:
    """The prototype of each character that isn't its own: built from the character database and the lists above."""
    table: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        form = unicodedata.decomposition(ch)
        if kind == "Cf":
            table[code] = ""
        elif kind == "Zs":
            table[code] = " "
        elif kind == "Nl" and form.startswith("<compat>") or form.startswith(FOLDED):
            table[code] = unicodedata.normalize("NFKD", ch)
    for seen, prototype in ALIKE:
        table.update(zip(map(ord, seen), prototype, strict=True))
    for low, high in UNSEEN_RANGES:
        table.update(dict.fromkeys(range(low, high + 1), ""))
    table.update(dict.fromkeys(UNSEEN, ""))
    return {code: "".join(table.get(ord(c), c) for c in to) for code, to in table.items()}


def skeleton(text: str) -> str:
    """The skeleton of a text; it is its own skeleton."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text).translate(prototypes())
    return unicodedata.normalize("NFD", text)


def skeletons(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id_column and skeleton of each row; null for a null text. Other columns are not read."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x.as_py() is None else skeleton(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_column, "skeleton"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(form, f"`{id_column}` {kind}, skeleton string")


def fingerprints(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text_hash and look_hash (128 bits each, of the text and of its skeleton) of each row whose text is neither
    null nor blank (a text whose skeleton has nothing but white space is blank)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, looks = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = x.as_py()
                if text is None or not (look := skeleton(text)).strip():
                    continue
                ids.append(i)
                texts.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                looks.append(xxhash.xxh3_128_digest(look.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(texts, pa.binary()), pa.array(looks, pa.binary())], names=["id", "text_hash", "look_hash"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(prints, f"id {kind}, text_hash binary, look_hash binary")


def look_classes(prints: DataFrame) -> DataFrame:
    """Of each look with several texts: look_hash, n_texts, n_rows, first_id. Counts are pre-aggregated, so a look with
    a third of all rows is no hot group."""
    return (
        prints.groupBy("look_hash", "text_hash")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .groupBy("look_hash")
        .agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"), F.min("first_id").alias("first_id"))
        .where("n_texts > 1")
    )


def class_pairs(prints: DataFrame) -> DataFrame:
    """text_hash_a < text_hash_b of each two texts of one look, however many rows have them."""
    texts = prints.select("look_hash", "text_hash").distinct().join(look_classes(prints).select("look_hash"), "look_hash", "left_semi")
    a, b = (texts.select("look_hash", F.col("text_hash").alias(f"text_hash_{s}")) for s in "ab")
    return a.join(b, "look_hash").where("text_hash_a < text_hash_b").select("text_hash_a", "text_hash_b")


def look_members(prints: DataFrame) -> DataFrame:
    """One row a document whose look several texts have: id, class_id (the smallest id of its look), text_id (the
    smallest id of its text), n_texts and n_rows of the look. However many rows have a look, no pair is made."""
    texts = prints.groupBy("look_hash", "text_hash").agg(F.min("id").alias("text_id"))
    looks = look_classes(prints).withColumnRenamed("first_id", "class_id")
    known = texts.join(looks, "look_hash").select("text_hash", "class_id", "text_id", "n_texts", "n_rows")
    return prints.select("id", "text_hash").join(known, "text_hash").drop("text_hash")


def look_alike_pairs(prints: DataFrame, pieces: int = 64) -> DataFrame:
    """Pairs of different ids (id_a < id_b) whose texts differ but look the same; an id occurs once in prints. Texts are
    paired first, then pairs of texts become pairs of rows, so that copies of one text make no pair; the rows of a text
    are cut by the hash of their id into `pieces`, each pair of which is a key of its own."""
    rows = prints.select("id", "text_hash", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("piece"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
    keys = class_pairs(prints)
    for side, s in ((a, "a"), (b, "b")):
        keys = keys.join(side.select(f"text_hash_{s}", f"piece_{s}").distinct(), f"text_hash_{s}")
    left, right = keys.join(a, ["text_hash_a", "piece_a"]), keys.join(b, ["text_hash_b", "piece_b"])
    both = left.join(right, ["text_hash_a", "piece_a", "text_hash_b", "piece_b"])
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
