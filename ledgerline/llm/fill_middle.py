"""Fill-in-the-middle transformation by boundary expressions: texts are cut by Spark's split where two classes of characters meet.

Each grammar of units becomes a zero-width expression that looks at the characters on both sides of a place, so
the pieces are all of the text and nothing else. All is Spark's own text functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = r"\x20\x09-\x0D"
#: Grammar -> (class of the character before a boundary, class of the character after it).
#: token: `[space]*[other]+|[space]+` matched from the left, so a unit ends where a space follows another character.
#: line: up to and with a line feed. char: one code point.
UNITS = {"token": (f"[^{_SPACE}]", f"[{_SPACE}]"), "line": (r"\n", r"[\s\S]"), "char": (r"[\s\S]", r"[\s\S]")}


def boundary(unit: str) -> str:
    """The zero-width expression that matches between two units of a grammar."""
    left, right = UNITS[unit]
    return f"(?<={left})(?={right})"


def pieces(text: Column, unit: str) -> Column:
    """The units of a text in order; none of an empty one, which split would give back as one empty piece."""
    return F.when(F.octet_length(text) > 0, F.split(text, boundary(unit), -1)).otherwise(F.array().cast("array<string>"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): each row of docs, whole, and its transformed text.

    The first four groups of 8 hex digits of the sha256 of `seed:id` are numbers h1 to h4. The prefix ends after the smaller
    of h1 % (n + 1) and h2 % (n + 1) of the n units, the middle after the larger. rate: percent of
    texts that are transformed (h3 % 100); spm: percent of those that begin with the suffix (h4 % 100).
    A text stays plain if it is empty, null (as empty) or holds a sentinel, so that restore gives
    every text back. A null id is hashed as an empty one; rows that repeat an id are cut by the same numbers;
    very long texts are cut whole; input columns of any names stay inside row; an empty table gives no rows.
    """
    text = F.coalesce(docs[f"`{text_column}`"], F.lit(""))
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[f"`{id_column}`"].cast("string"), F.lit(""))).cast("binary"), 256)
    cut = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text.alias("text"), told.alias("told"), pieces(text, unit).alias("units"))
    h = [F.conv(F.substring("told", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = F.size("units").cast("long")
    ends = [(h[k] % (n + 1)).cast("int") for k in (0, 1)]
    plain = (n == 0) | (h[2] % 100 >= rate)
    for s in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(s))
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    dealt = cut.select("row", "text", "units", n.alias("n"), form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    part = {"p": F.slice("units", F.lit(1), F.col("a")), "m": F.slice("units", F.col("a") + 1, F.col("b") - F.col("a")), "s": F.slice("units", F.col("b") + 1, F.size("units"))}
    joined = dealt.select("row", "text", "n", "form", *[F.when(F.col("form") != "plain", F.array_join(v, "")).alias(k) for k, v in part.items()])
    psm, spm_ = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m"), F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return joined.select("row", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), output.alias("output"))
