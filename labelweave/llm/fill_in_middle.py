"""Fill-in-middle: texts cut into units by a zero-width pattern, two cuts, and the parts put in another order.

A unit grammar says which neighbouring characters belong to one unit. It becomes a pattern that matches nothing but the
places between two units: what stands on either side is looked at, never consumed, so Spark's split loses no character
and the pieces joined again are the text. Cuts, forms and orders come from a hash of the row's id: a task that is run again
gives the same rows. Everything is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import free_name, kept_columns, quoted, text_or_empty

ANY = r"(?s:.)"


@dataclass(frozen=True)
class Runs:
    """Units are the longest runs of characters of one class; a character of no class is a unit. The first class that a character is in counts.

    classes: contents of character classes, such as r"\\p{L}" or "a-z_"; an empty tuple makes every code point a unit.
    """

    classes: tuple[str, ...] = ()

    def boundary(self) -> str:
        # between any two characters, but not between two of the same class
        own = [f"[[{c}]&&[^{''.join(self.classes[:k])}]]" if k else f"[{c}]" for k, c in enumerate(self.classes)]
        joined = "|".join(f"(?<={c}){c}" for c in own)
        return f"(?<={ANY})" + (f"(?!{joined})" if joined else "") + f"(?={ANY})"


@dataclass(frozen=True)
class Neighbours:
    """A unit ends where a character of the class `left` meets one of `right`; None is any character."""

    left: str | None
    right: str | None

    def boundary(self) -> str:
        side = lambda c: ANY if c is None else f"[{c}]"
        return f"(?<={side(self.left)})(?={side(self.right)})"


#: Code points; words with the white space before them; lines with their end; sentences with the space before them; runs of letters, digits or white space, all else alone.
GRAMMARS = {
    "code_points": Runs(),
    "words": Neighbours(r"\S", r"\s"),
    "lines": Neighbours(r"\n", None),
    "sentences": Neighbours(r".!?。", r"\s"),
    "tokens": Runs((r"\p{L}\p{M}", r"\p{N}", r"\s")),
}


def pieces(text: Column, grammar: Runs | Neighbours) -> Column:
    """The units of a text in order; none of an empty text, which split would take for one piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits, from 1, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def holds(text: Column, marks: tuple[str, ...]) -> Column:
    found = text.contains(marks[0])
    for m in marks[1:]:
        found |= text.contains(m)
    return found


def check_marks(marks: tuple[str, ...]) -> None:
    """Texts without a mark can be restored only if no mark can begin within another or within what it ends."""
    for a in marks:
        for b in marks:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b) or not a:
                raise ValueError(f"marks overlap: {a!r} and {b!r}")


def restored(output: Column, form: Column, marks: tuple[str, str, str]) -> Column:
    """The text again, from what was put out and its form alone: no part holds a mark, so the first ones found are those put in."""
    prefix_mark, suffix_mark, middle_mark = marks
    head, tail = F.substring_index(output, suffix_mark, 1), F.substring_index(output, suffix_mark, -1)
    psm = F.concat(F.substring_index(head, prefix_mark, -1), F.substring_index(tail, middle_mark, -1), F.substring_index(tail, middle_mark, 1))
    # suffix, then prefix, then middle
    suffix, rest = F.substring_index(tail, prefix_mark, 1), F.substring_index(output, prefix_mark, -1)
    spm = F.concat(F.substring_index(rest, middle_mark, 1), F.substring_index(rest, middle_mark, -1), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    df: DataFrame,
    grammar: str | Runs | Neighbours = "code_points",
    text: str = "text",
    key: str = "doc_id",
    seed: int = 1,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    percent: int = 90,
    suffix_first: int = 20,
    names: tuple[str, ...] = ("n_units", "form", "prefix", "middle", "suffix", "fim_text"),
) -> DataFrame:
    """df with its texts' number of units, their form, their parts and the text put together for infilling.

    grammar: a name of GRAMMARS or a grammar. Of the SHA-256 of `seed:key` the first four groups of eight hexadecimal digits are
    drawn: two cuts between 0 and n units, whether the text stays plain (draw 3 % 100 >= percent) and whether the
    suffix comes first (draw 4 % 100 < suffix_first): marks[1] suffix marks[0] prefix marks[2] middle, else marks[0]
    prefix marks[1] suffix marks[2] middle. Texts that hold a mark stay plain, so do empty ones; a null text counts as
    empty. Plain rows have null parts. A null key draws as an empty one; rows that repeat are treated alike. Nothing is cut
    off long texts. An empty table gives an empty result. Columns of df that have one of the names, in any case, are replaced.
    No shuffle: rows are treated where they are.
    """
    check_marks(marks)
    rule = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    n_units, form, prefix, middle, suffix, out = names
    t, units, digest, low, high, plain = (free_name(df, f"__{x}", *names) for x in ("t", "units", "digest", "low", "high", "plain"))
    base = df.withColumns({t: text_or_empty(text), digest: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit(""))), 256)})
    base = base.withColumn(units, pieces(F.col(t), rule)).withColumn(plain, (F.col(t) == "") | holds(F.col(t), marks) | (draw(F.col(digest), 3) % 100 >= percent))
    n = F.size(units).cast("long")
    cut = [draw(F.col(digest), k) % (n + 1) for k in (1, 2)]
    base = base.withColumns({low: F.least(*cut).cast("int"), high: F.greatest(*cut).cast("int")})
    part = lambda a, b: F.when(~F.col(plain), F.array_join(F.slice(units, a + 1, b - a), ""))
    lo, hi, zero = F.col(low), F.col(high), F.lit(0)
    rest = kept_columns(df, names)
    made = {n_units: n, prefix: part(zero, lo), middle: part(lo, hi), suffix: part(hi, F.size(units))}
    cut_up = base.select(*rest, t, plain, digest, *[v.alias(k) for k, v in made.items()])
    order = F.when(F.col(plain), "plain").when(draw(F.col(digest), 4) % 100 < suffix_first, "spm").otherwise("psm")
    cut_up = cut_up.withColumn(form, order)
    p, s, m = (F.lit(x) for x in marks)
    before, within, after = (quoted(c) for c in (prefix, middle, suffix))
    whole = F.when(quoted(form) == "psm", F.concat(p, before, s, after, m, within)).when(quoted(form) == "spm", F.concat(s, after, p, before, m, within)).otherwise(F.col(t))
    return cut_up.select(*rest, *[quoted(c) for c in names[:5]], whole.alias(out))

