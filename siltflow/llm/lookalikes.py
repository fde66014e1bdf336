"""One consistent form for text that looks the same but is made of other characters."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltflow.plans.lineage import store

# Letters of other scripts beside the Latin letters they look like. They come before what Unicode's own
# table of confusable characters says of the rest, see ``confusable``.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮԌԚԜ" + "аеѕіјорсухһԁԛԝӏү"
CYRILLIC_AS = "ABESIJKMHOPCTXYGQW" + "aesijopcyxhdqwly"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ανοριυκχϲϳ"
GREEK_AS = "ABEZHIKMNOPTYX" + "avopiukxcj"
OTHERS = "ՕօոսհցԼꓐꓑꓒꓓꓔꓖꓗꓘꓙꓚꓝꓞꓟꓠꓡꓢꓣꓦꓪꓫꓬꓮꓰꓲꓳꓴ"
OTHERS_AS = "OonuhgLBPdDTGKKJCFFMNLSRVWXYAEIOU"
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_NO_SHAPE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(maxsize=1)
def confusable() -> dict[str, str]:
    """Letters of other scripts and the one Latin letter each is confused with, by Unicode's confusables data.

    The data come with the ICU library that Spark itself uses: two characters are confusable when their skeletons are
    equal. Of several Latin letters of one skeleton the one in the letter's own case is taken. Compatibility forms are left
    to the character data, as are Latin letters with strokes, hooks and the like, which are letters of their own.
    """
    latin = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c and "LATIN" not in unicodedata.name(c, "LATIN")]
    checker = getattr(SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
    skeletons = checker.getSkeleton("\n".join([*latin, *rest])).split("\n")
    of: dict[str, list[str]] = {}
    for x, s in zip(latin, skeletons):
        of.setdefault(s, []).append(x)
    found = {}
    for c, s in zip(rest, skeletons[len(latin) :]):
        if like := of.get(s):
            found[c] = next((x for x in like if x.isupper() == c.isupper()), like[0])
    return found


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(one character -> one or none, one -> several, letter and accent -> letter), all made by rule
    from the Unicode character data: compatibility forms of letters and digits become those, every
    space becomes U+0020, formatting characters go, and a letter of another script with accents
    becomes its Latin look-alike with the same accents."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    pairs: dict[str, str] = {}
    alike = confusable() | dict(zip(CYRILLIC + GREEK + OTHERS, CYRILLIC_AS + GREEK_AS + OTHERS_AS))
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c == " " or kind in ("Cn", "Co", "Cs"):
            continue
        if kind in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x85":
            one[c] = " "
        elif cp in _NO_SHAPE or kind == "Cc" or (kind == "Cf" and cp not in _VISIBLE_FORMAT):
            one[c] = ""
        elif c in alike:
            one[c] = alike[c]
        elif parts := unicodedata.decomposition(c).split():
            if parts[0][0] == "<":
                plain = unicodedata.normalize("NFKC", c)
                if kind[0] in "LN" and plain != c and plain.isalnum():
                    plain = "".join(alike.get(x, x) for x in plain)
                    (one if len(plain) == 1 else several)[c] = plain
                continue
            full = unicodedata.normalize("NFD", c)
            if full[0] in alike and len(full) > 1:
                like = unicodedata.normalize("NFC", alike[full[0]] + full[1:])
                if len(like) == 1:
                    one[c] = like
                    continue
            if unicodedata.normalize("NFC", c) != c:
                (one if len(unicodedata.normalize("NFC", c)) == 1 else several)[c] = unicodedata.normalize("NFC", c)
            elif len(parts) == 2 and unicodedata.category(chr(int(parts[1], 16)))[0] == "M":
                pairs["".join(chr(int(p, 16)) for p in parts)] = c
    return one, several, pairs


def _lookup(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _any_of(chars: str) -> str:
    """A character class of a regular expression, neighbours in code order as ranges."""
    out, points = [], sorted(map(ord, chars))
    for n, p in enumerate(points):
        if n and p == points[n - 1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def plain_letters(text: Column) -> Column:
    """Every character by itself: spaces, and the letters and digits that other characters look like. Shapeless characters and separate accents stay."""
    one, several, _ = tables()
    kept = {a: b for a, b in one.items() if b and a != "\0"}
    plain = F.translate(text, "".join(kept), "".join(kept.values()))
    wide = _lookup(several)
    opened = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.element_at(wide, c), c)), "")
    return F.when(plain.rlike(_any_of("".join(several))), opened).otherwise(plain)


def tidy(plain: Column) -> Column:
    """Without shapeless characters, and with letter and accent as one character where there is one."""
    one, _, pairs = tables()
    seen = F.translate(plain, "".join(a for a, b in one.items() if not b and a != "\0"), "")
    known = _lookup(pairs)
    joined = F.aggregate(
        F.split(seen, ""),
        F.lit(""),
        lambda acc, c: F.when(
            c.rlike(r"^\p{M}") & F.element_at(known, F.concat(F.right(acc, F.lit(1)), c)).isNotNull(),
            F.concat(F.left(acc, F.length(acc) - 1), F.element_at(known, F.concat(F.right(acc, F.lit(1)), c))),
        ).otherwise(F.concat(acc, c)),
    )
    return F.when(seen.rlike(r"\p{M}"), joined).otherwise(seen)


def _odd(text: Column) -> Column:
    """Whether there is anything beside printable ASCII; a text without is in its consistent form."""
    return text.rlike(r"[^ -~]")


def consistent(text: Column) -> Column:
    """The look-alike map as an expression. Printable ASCII is passed on as it is. Null stays null and blank text blank."""
    return F.when(_odd(text), tidy(plain_letters(text))).otherwise(text)


def canonical_forms(values: DataFrame) -> DataFrame:
    """(value, clean) for a column ``value`` of distinct texts that hold anything beside printable ASCII; others are left out, being their own form.

    Letters are mapped, then values are grouped under accent- and case-sensitive Unicode collation, under which texts are
    equal that only differ in shapeless characters or in the way accented letters and syllables are put together. Each
    member offers its tidy form; the one of fewest characters, of those the least in code point order, stands for the class.
    Null is left out; empty input gives an empty result.
    """
    mapped = values.where(_odd(F.col("value"))).select("value", plain_letters(F.col("value")).alias("plain")).withColumn("tidy", tidy(F.col("plain")))
    mapped = store(mapped).df  # read twice
    return values.sparkSession.sql(
        """
        SELECT m.value, c.canon AS clean
        FROM {mapped} m JOIN (
          SELECT collate(plain, 'UNICODE') AS class, min_by(tidy, struct(length(tidy), tidy)) AS canon
          FROM {mapped} GROUP BY collate(plain, 'UNICODE')) c
        ON collate(m.plain, 'UNICODE') = c.class
        """,
        mapped=mapped,
    )


def unify(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id, col_name, value, clean): one row per id and column whose value has a consistent form other than itself.

    Values of printable ASCII are never shuffled. Repeated rows give one row. Null ids and null values are left out. Columns beside those named are not read.
    """
    long = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("e")
    ).select("id", "e.col_name", "e.value").where(_odd(F.col("value")))
    forms = canonical_forms(long.select("value").distinct()).where("clean <> value")
    return long.join(forms, "value").select("id", "col_name", "value", "clean").distinct()
