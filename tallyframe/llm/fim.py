"""Fill-in-middle transformation: texts are cut into units by lookaround splitting and rearranged around a middle.

A unit grammar says which neighbouring characters belong together. It is translated into one zero-width regular
expression that matches between two neighbouring characters where a unit ends, so Spark's split cuts there and keeps
every character. Whether a unit ends depends on the two neighbours alone; so a long text can be split in blocks that
overlap by one character, and no array holds more than a block's pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import documents

#: Code points that are split at once.
BLOCK = 1 << 17
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Units:
    """A grammar. runs: character classes; neighbours of the same class stay in one unit. ends: a class after whose
    characters a unit ends, and only there. With neither, each code point is a unit. Classes are written as between
    the brackets of a Java regular expression."""

    runs: tuple[str, ...] = ()
    ends: str | None = None

    def boundary(self) -> str:
        """The zero-width expression: one lookbehind and one lookahead at each place it compares."""
        between = lambda left, right: f"(?<={left})(?={right})"
        if self.ends is not None:
            return "(?s)" + between(f"[{self.ends}]", ".") + _WIDE
        return "(?s)" + between(".", ".") + "".join(f"(?!{between(f'[{c}]', f'[{c}]')})" for c in self.runs) + (_WIDE if self.runs else "")


#: Matches nothing, always. As it holds a character beyond 16 bits, Java looks back by code points, not by halves of them.
_WIDE = "(?:|\U00010000)"

UNITS = {
    "code_point": Units(),
    "word": Units(runs=(r"\p{L}\p{M}\p{N}_", r"\s")),
    "line": Units(ends=r"\n"),
}


def _block(text: Column, i: Column) -> Column:
    """Block i of a text with the first character of the next one."""
    return F.substring(text, i * BLOCK + 1, F.lit(BLOCK + 1))


def with_units(df: DataFrame, text: str, units: Units = UNITS["code_point"]) -> DataFrame:
    """df with _units, the text's number of units (0 for an empty one), and what cut_in_three needs: _pieces (the units
    of a text of one block) or _ends (the number of unit ends in each block, without the text's own end). text must
    not be null."""
    regex = units.boundary()
    last = F.floor((F.length(text) - 1) / BLOCK).cast("int")
    short = F.length(text) <= BLOCK
    # split gives one empty piece for an empty text, which is no unit
    split = df.withColumn("_pieces", F.when(F.length(text) == 0, F.array().cast("array<string>")).when(short, F.split(text, regex)))
    ends = F.when(~short, F.transform(F.sequence(F.lit(0), last), lambda i: F.size(F.split(_block(F.col(text), i), regex)) - 1))
    counted = split.withColumn("_ends", ends)
    total = F.aggregate("_ends", F.lit(1).cast("long"), lambda a, x: a + x)
    return counted.withColumn("_units", F.coalesce(total, F.size("_pieces").cast("long")))


def _place(text: str, units: Units, at: Column) -> Column:
    """The code points of a long text's first `at` units: the block that holds the unit's end is found by the running
    count of ends and split again."""
    last = F.array(F.struct(F.lit(0).alias("block"), at.alias("left"), F.lit(False).alias("found")))[0]

    def step(a: Column, ends: Column) -> Column:
        on = F.struct((a["block"] + 1).alias("block"), (a["left"] - ends).alias("left"), F.lit(False).alias("found"))
        here = F.struct(a["block"].alias("block"), a["left"].alias("left"), F.lit(True).alias("found"))
        return F.when(a["found"] | (a["left"] <= ends), here).otherwise(on)

    def inside(f: Column) -> Column:
        pieces = F.split(_block(F.col(text), f["block"]), units.boundary())
        return f["block"] * F.lit(BLOCK).cast("long") + F.length(F.array_join(F.slice(pieces, F.lit(1), f["left"].cast("int")), ""))

    place = F.transform(F.array(F.aggregate("_ends", last, step)), inside)[0]
    return F.when(at == 0, F.lit(0).cast("long")).when(at == F.col("_units"), F.length(text).cast("long")).otherwise(place)


def cut_in_three(df: DataFrame, text: str, first: Column, second: Column, units: Units = UNITS["code_point"]) -> DataFrame:
    """with_units' df with prefix, middle and suffix: the first `first` units, those up to `second`, the rest. An error
    unless 0 <= first <= second <= _units; null where first or second is null."""
    cuts = df.withColumn("_a", first.cast("long")).withColumn("_b", second.cast("long"))
    a, b, n = F.col("_a"), F.col("_b"), F.col("_units")
    checked = cuts.withColumn("_b", F.when((a < 0) | (a > b) | (b > n), F.raise_error(F.lit("a cut lies outside the text")).cast("long")).otherwise(b))
    long_text = F.col("_pieces").isNull()
    placed = checked.withColumn("_p", F.when(long_text, _place(text, units, a))).withColumn("_q", F.when(long_text, _place(text, units, b)))
    p, q = F.col("_p"), F.col("_q")
    joined = lambda start, size: F.array_join(F.slice("_pieces", (start + 1).cast("int"), size.cast("int")), "")
    part = lambda start, size: F.substring(F.col(text), (start + 1).cast("int"), size.cast("int"))
    none = F.lit(0).cast("long")
    parts = {"prefix": ((none, a), (none, p)), "middle": ((a, b - a), (p, q - p)), "suffix": ((b, n - b), (q, F.length(text) - q))}
    return placed.withColumns({c: F.when(long_text, part(*long)).otherwise(joined(*short)) for c, (short, long) in parts.items()}).drop("_a", "_b", "_p", "_q")


def arranged(form: Column) -> Column:
    """The text in its form, from the columns text, prefix, middle and suffix."""
    p, m, s = (F.col(c) for c in ("prefix", "middle", "suffix"))
    psm, spm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(F.col("text"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an arranged text and its form alone. Sentinels are in no text that was rearranged, and no
    two of them overlap, so the output parts at them in one way."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, units: Units = UNITS["code_point"]) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output for every row.

    The cuts are drawn from the hash of seed and doc_id, any of the n + 1 places alike. Plain are texts that are empty
    or hold a sentinel, and plain_percent of all; spm_percent of the others put the suffix first. A null text is
    empty; a null doc_id draws as the empty id; equal rows give equal rows. Other columns are left behind, an empty
    table gives an empty one. A text is handled whole, in blocks of BLOCK code points. Narrow: no shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("_h"))
    h = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
    text = F.col("text")
    plain = (F.length(text) == 0) | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    counted = with_units(rows.withColumn("form", form), "text", units)
    a, b = h(0) % (F.col("_units") + 1), h(1) % (F.col("_units") + 1)
    whole = F.col("form") == "plain"  # not cut
    cut = cut_in_three(counted, "text", F.when(~whole, F.least(a, b)), F.when(~whole, F.greatest(a, b)), units)
    return cut.select("doc_id", F.col("_units").alias("n"), "form", "prefix", "middle", "suffix", arranged(F.col("form")).alias("output"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every document: nulls, empty
    and very long texts as in fill_in_middle."""
    made = fill_in_middle(documents(spark, sf_dir, "doc_id", "text"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM d
),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm'
    ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k
),
c AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
