"""Fill-in-middle transformation, in SQL functions alone.

A text is cut into units, lines by default. A hash of the document's id says where
the middle begins and ends, whether the text is rearranged at all, and whether the
suffix comes first. Sentinels stand between the parts, so that the text can be told
from what was made of it. Each row is made from itself alone: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units: lines, each with its line break.
UNITS = r"[^\n]*\n|[^\n]+"
#: What goes before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _refuse_overlaps(sentinels: tuple[str, str, str]) -> None:
    """Sentinels are told apart anywhere only if none lies in another and no end of one begins another, or itself."""
    for i, a in enumerate(sentinels):
        for k, b in enumerate(sentinels):
            if not a or (i != k and a in b) or any(b.startswith(a[at:]) for at in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")


def _bits(digest: Column, group: int) -> Column:
    """A group of 8 hexadecimal digits, counted from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, units: str = UNITS, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row of docs: (id, n, form, prefix_chars, middle_chars, output).

    n is the number of units. form is plain (output is the text), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle); rate and suffix_first are per cents of the
    texts and of those rearranged. Parts are counted in code points, null if plain.
    A null text is an empty one, which is plain, as is a text with a sentinel in it, or
    one that the units don't cover. A null id is hashed as empty text. Repeated rows have
    equal results; an empty table gives no rows. Texts are cut whole, however long.
    Other columns are not read. Raises ValueError for sentinels that overlap.
    """
    _refuse_overlaps(sentinels)
    before, after, between = map(F.lit, sentinels)
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256).alias("digest"), F.regexp_extract_all(text, F.lit(units), F.lit(0)).alias("units"))
    out = out.withColumn("n", F.size("units").cast("long"))
    cuts = [_bits(F.col("digest"), k) % (F.col("n") + 1) for k in range(2)]
    odd = (F.col("text") == "") | (F.array_join("units", "") != F.col("text")) | (_bits(F.col("digest"), 2) % 100 >= rate)
    for s in sentinels:
        odd |= F.contains("text", F.lit(s))
    form = F.when(odd, "plain").when(_bits(F.col("digest"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    out = out.select("id", "text", "units", "n", F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"), form.alias("form"))

    def part(start, size):
        return F.array_join(F.slice("units", start, size), "")

    parts = [part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("b") - F.col("a")), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b"))]
    out = out.select("id", "text", "n", "form", *[p.alias(c) for p, c in zip(parts, ("prefix", "middle", "suffix"))])
    psm = F.concat(before, "prefix", after, "suffix", between, "middle")
    spm = F.concat(after, "suffix", before, "prefix", between, "middle")
    plain = F.col("form") == "plain"
    size = [F.when(~plain, F.length(c)).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    out = out.select("id", "n", "form", *size, F.when(plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that rearrange made output from, by its sentinels and form. No text that was rearranged has a sentinel, so each stands once."""
    before, after, between = sentinels
    middle = F.substring_index(output, between, -1)
    rest = F.substring_index(output, between, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, after, 1), before, -1), middle, F.substring_index(rest, after, -1))
    spm = F.concat(F.substring_index(rest, before, -1), middle, F.substring_index(F.substring_index(rest, before, 1), after, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
