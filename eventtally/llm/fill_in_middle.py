"""Fill-in-middle transformation by counted quantifiers.

`regexp_count` gives a text's number of units, n; hashes of the seed and the id give
two cuts a <= b in 0..n.  A pattern made for the row, `unit{a}+` and `unit{b-a}+` as
possessive groups and a third for the rest, captures prefix, middle and suffix in one
match, and the replacement puts them in the order of the row's form between sentinels:

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle
    plain  the text as it is

Units are counted in whole blocks first, then those that are left, so that the matches
`regexp_count` holds are a copy of the text and not an object a character.

Defined results: a null text is empty, and an empty text plain; so is one that contains
a sentinel; a null id hashes as if it were empty; rows with the same id get the same
hashes, so copies get the same cuts; prefix_chars and middle_chars are null for plain.
Columns of `docs` that have a result's name are replaced, all others pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point; any expression whose matches tile every text may take its place.
CODE_POINT = "."
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred documents, how many stay plain, and how many of the others have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Units of a block of `count_units`.
BLOCK_UNITS = 256

RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels of which none begins where another, or itself, has not ended: a text without them is found again."""
    for i, one in enumerate(sentinels):
        for j, other in enumerate(sentinels):
            within = i != j and one in other
            if not one or within or any(one.endswith(other[:k]) for k in range(1, len(other))) or "\\E" in one:
                raise ValueError(f"sentinels must not overlap: {one!r}, {other!r}")


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units a text has."""
    block = F.lit(f"(?s)(?:{unit}){{{BLOCK_UNITS}}}+")
    rest = F.regexp_replace(text, block, F.lit(""))
    return F.regexp_count(text, block).cast("long") * BLOCK_UNITS + F.regexp_count(rest, F.lit(f"(?s){unit}"))


def hashes(id_: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of `seed:id`, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _literal(sentinel: str) -> str:
    """A sentinel in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", sentinel)


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED, unit: str = CODE_POINT,
    sentinels: tuple[str, str, str] = SENTINELS,
    plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """`docs` with n (units), form, prefix_chars and middle_chars (units) and output."""
    _check(sentinels)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = hashes(F.col(f"`{id_column}`"), seed)
    counted = docs.withColumns({"__text": whole, "__n": count_units(whole, unit)})
    cuts = [h % (F.col("__n") + 1) for h in (h1, h2)]
    marked = (F.col("__n") == 0) | (h3 % 100 >= 100 - plain_percent)
    for sentinel in sentinels:
        marked |= F.contains("__text", F.lit(sentinel))
    form = F.when(marked, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    cut = counted.withColumns({"__a": F.least(*cuts), "__b": F.greatest(*cuts), "__form": form})
    pattern = F.format_string(f"(?s)\\A((?:{unit.replace('%', '%%')}){{%d}}+)((?:{unit.replace('%', '%%')}){{%d}}+)(.*+)\\z", F.col("__a"), F.col("__b") - F.col("__a"))
    before, after, middle = map(_literal, sentinels)
    order = F.when(F.col("__form") == "spm", f"{after}$3{before}$1{middle}$2").otherwise(f"{before}$1{after}$3{middle}$2")
    is_cut = F.col("__form") != "plain"
    output = F.when(is_cut, F.regexp_replace("__text", pattern, order)).otherwise(F.col("__text"))
    found = {
        "n": F.col("__n"), "form": F.col("__form"), "prefix_chars": F.when(is_cut, F.col("__a")),
        "middle_chars": F.when(is_cut, F.col("__b") - F.col("__a")), "output": output,
    }
    own = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    return cut.select(*own, *[column.alias(name) for name, column in found.items()])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    before, after, middle = (f"\\Q{s}\\E" for s in sentinels)
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{before}(.*?){after}(.*?){middle}(.*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{after}(.*?){before}(.*?){middle}(.*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
